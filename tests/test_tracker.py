"""The stateful stream against plain loops: triggers, duplicates, re-reading, the snapshot, timers, a batch that runs again."""
import random

import pytest

from dossierflow.streaming import tracker

SCHEMA = "k long, message string, dir string, cls string, decision string, ts timestamp"


def land(spark, folder, rows, n):
    spark.createDataFrame(rows, "k long, message string, dir string, cls string, decision string, ts string").selectExpr(
        "k", "message", "dir", "cls", "decision", "cast(ts as timestamp) ts").coalesce(1).write.parquet(f"{folder}/landed/part={n}")


def run(spark, folder, records):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/landed/*")
    query = tracker.run_available(stream, records, "k", "ts", f"{folder}/job")
    query.awaitTermination(180)
    assert query.exception() is None


def snapshot(spark):
    return spark.createDataFrame([(1, "prepared", None, None, None, "2024-01-01"), (2, "rejected", "2023-12-01", None, None, None)],
                                 "k long, stage string, sent string, last_inbound string, opened string, prepared string")


def test_triggers_duplicates_and_rereading(spark, tmp_path):
    records = snapshot(spark)
    land(spark, tmp_path, [(1, "a", "out", "sent", "auto", "2024-01-03 10:00:00"), (1, "b", "in", "ack", "unmatched", "2024-01-04 10:00:00"),
                           (2, "c", "in", "offer", "auto", "2024-01-04 11:00:00"), (3, "d", "out", "sent", "auto", "2024-01-04 12:00:00")], 0)
    run(spark, tmp_path, records)
    got = {r["key"]: tuple(r)[1:] for r in tracker.latest(spark, f"{tmp_path}/job/records").collect()}
    assert got == {"1": ("applied", "2024-01-03", None, None), "2": ("rejected", "2023-12-01", "2024-01-04", None), "3": ("applied", "2024-01-04", None, None)}
    land(spark, tmp_path, [(1, "a", "out", "sent", "auto", "2024-01-02 10:00:00"), (1, "b", "in", "ack", "auto", "2024-01-04 10:00:00"),
                           (1, "e", "in", "interview", "suggested", "2024-01-05 10:00:00")], 1)
    run(spark, tmp_path, records)
    got = {r["key"]: tuple(r)[1:] for r in tracker.latest(spark, f"{tmp_path}/job/records").collect()}
    assert got["1"] == ("ack", "2024-01-03", "2024-01-04", None)


def test_follow_up_timer(spark, tmp_path):
    land(spark, tmp_path, [(1, "a", "out", "sent", "auto", "2024-01-03 10:00:00"), (2, "b", "out", "sent", "auto", "2024-01-03 10:00:00")], 0)
    land(spark, tmp_path, [(2, "c", "in", "ack", "auto", "2024-01-05 10:00:00"), (9, "z", "in", "ack", "auto", "2024-02-01 10:00:00")], 1)
    land(spark, tmp_path, [(9, "y", "in", "ack", "auto", "2024-02-02 10:00:00")], 2)
    run(spark, tmp_path, snapshot(spark).where("k = 1"))
    assert [r["key"] for r in tracker.latest(spark, f"{tmp_path}/job/records", "due").collect()] == ["1"]


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    write = tracker.upsert_batches(f"{tmp_path}/records")
    row = lambda stage: spark.createDataFrame([("1", "record", stage, None, None, None)], tracker.schema("key", ("kind", *tracker.FIELDS)))
    for stage, batch in (("applied", 0), ("ack", 1), ("ack", 1), ("applied", 0)):
        write(row(stage), batch)
    assert [r["stage"] for r in tracker.latest(spark, f"{tmp_path}/records").collect()] == ["ack"]


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_equals_a_plain_loop(spark, tmp_path, parts):
    rng = random.Random(parts)
    rows = [(rng.randint(1, 5), f"m{rng.randint(0, 150)}", rng.choice(["in", "in", "out"]), rng.choice(["ack", "read", "bounce", "info", "rejection", "odd"]),
             rng.choice(["auto", "auto", "unmatched"]), f"2024-01-{1 + i // 10:02d} {i % 10:02d}:00:00") for i in range(200)]
    for n in range(parts):
        land(spark, tmp_path, rows[n * 200 // parts:(n + 1) * 200 // parts], n)
    run(spark, tmp_path, snapshot(spark))
    states, seen = {1: {"stage": "prepared", "sent": None, "last_inbound": None, "opened": None, "prepared": "2024-01-01"},
                    2: {"stage": "rejected", "sent": "2023-12-01", "last_inbound": None, "opened": None, "prepared": None}}, {}
    for k, m, way, cls, decision, ts in rows:
        if seen.get((k, m)) not in (None, "unmatched"):
            continue
        seen[(k, m)] = decision
        if decision == "auto":
            states[k] = tracker.applied(states.get(k, {"stage": "none", "sent": None, "last_inbound": None, "opened": None, "prepared": None}), way, cls, ts[:10])
    got = {int(r["key"]): tuple(r)[1:] for r in tracker.latest(spark, f"{tmp_path}/job/records").collect()}
    assert got == {k: tuple(s[f] for f in tracker.FIELDS) for k, s in states.items()}
