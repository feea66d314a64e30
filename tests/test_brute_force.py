"""Queries without SQL, and skew-safe forms, against plain loops on small fixtures; stream against batch."""
import datetime as dtm
import random
import uuid

import pytest
from pyspark.sql import functions as F

from dossierflow.operators import intervals as iv
from dossierflow.operators import links as lk
from dossierflow.operators import messages as ms
from dossierflow.operators.scale import bucketed_rank, salted_join
from dossierflow.streaming import jobs


def test_strongest_spans(spark):
    patterns = ["the", "and the", "in the", "of", "of the", "the on"]
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the", "and", "in", "of", "on", "x."]) for _ in range(30))) for i in range(40)]

    def brute(text):
        low = " " + "".join(c if c.isalnum() else " " for c in text.lower()) + " "
        hits = []
        for rank, p in enumerate(patterns):
            at = low.find(f" {p} ")
            while at >= 0:
                hits.append((-len(p), at, rank, at + len(p)))
                at = low.find(f" {p} ", at + 1)
        kept = []
        for h in sorted(hits):
            if not any(h[1] < k[3] and k[1] < h[3] for k in kept):
                kept.append(h)
        return sorted((k[1], k[3], k[2]) for k in kept)

    found = iv.strongest_in(spark.createDataFrame(rows, "i int, text string"), "i", "text", patterns).collect()
    for i, text in rows:
        assert [tuple(r)[1:] for r in found if r["i"] == i] == brute(text)


def admitted(rows, n, seconds):
    out, state = {}, {}
    for k, ts, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        times = [t for t in state.get(k, []) if (ts - t).total_seconds() < seconds]
        ok = len(times) < n
        state[k] = times + [ts] if ok else times
        out[i] = ok
    return out


@pytest.fixture(scope="module")
def requests():
    rng = random.Random(7)
    t0 = dtm.datetime(2024, 1, 1)
    rows = [(0 if rng.random() < 0.5 else rng.randrange(1, 6), t0 + dtm.timedelta(seconds=int(rng.random() ** 2 * 40000)), i) for i in range(1500)]
    return rows


def test_limiter_batch_and_stream(spark, requests, tmp_path):
    df = spark.createDataFrame(requests, "k bigint, ts timestamp, i bigint")
    want = admitted(requests, 3, 60)
    got = {r["i"]: r["accepted"] for r in jobs.admit_batch(df, "k", "ts", "i", 3, 60).collect()}
    assert got == want
    src = tmp_path / "in"
    df.coalesce(1).write.parquet(str(src))
    name = "adm_" + uuid.uuid4().hex[:6]
    stream = jobs.admit_stream(spark.readStream.schema(df.schema).parquet(str(src)), "k", "ts", "i", 3, 60)
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["i"]: r["accepted"] for r in spark.table(name).collect()} == want


def test_trailing_rate(spark, requests):
    df = spark.createDataFrame(requests, "k bigint, ts timestamp, i bigint")
    got = {r["i"]: r["n_before"] for r in iv.trailing_rate(df, ["k"], "ts", "i", 3, 60).collect()}
    for k, ts, i in requests:
        assert got[i] == sum(1 for k2, t2, j in requests if k2 == k and (t2, j) < (ts, i) and (ts - t2).total_seconds() < 60)


def test_dedupe_and_fold_stream_equal_batch(spark, tmp_path):
    rng = random.Random(3)
    t0 = dtm.datetime(2024, 1, 1)
    rows = [(rng.randrange(40), rng.choice(["rejection", "bounce", "read", "ack", "info", "offer", "other"]), t0 + dtm.timedelta(minutes=i), f"m{rng.randrange(250)}") for i in range(300)]
    df = spark.createDataFrame(rows, "rec int, cls string, ts timestamp, key string")
    src = tmp_path / "in"
    df.coalesce(1).write.parquet(str(src))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(src))

    def run(frame, mode):
        name = "q_" + uuid.uuid4().hex[:6]
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert {r["key"] for r in run(jobs.dedupe_stream(read(), "key", "ts"), "append")} == {r[3] for r in rows}
    batch = {r["rec"]: r["stage"] for r in ms.fold_stage(df, ["rec"], "cls", "ts", F.lit("prepared")).collect()}
    live = {r["rec"]: r["stage"] for r in run(ms.fold_stage(read(), ["rec"], "cls", "ts", F.lit("prepared")), "complete")}
    assert live == batch


def test_available_now_refresh_is_idempotent(spark, tmp_path):
    landed, out, ck = (str(tmp_path / x) for x in ("landed", "out", "ck"))
    df = spark.range(50).select("id", (F.col("id") % 3).cast("string").alias("source"))
    df.write.parquet(landed)
    sink = lambda batch, n: batch.write.mode("append").parquet(out)
    for _ in range(2):
        jobs.refresh_available(spark, landed, df.schema, sink, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 50


def test_hot_key_ranks_and_joins(spark):
    """One key holds most rows; ranks and joins must not change with the partitioning."""
    df = spark.range(3000).select(F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id")).alias("k"), "id", F.pmod(F.hash("id"), F.lit(500)).alias("v"))
    ranked = bucketed_rank(df.repartition(13), ["k"], F.floor(F.col("v") / 50), [F.col("v"), F.col("id")])
    got = [r["id"] for r in ranked.where("k = 0").orderBy("rk").collect()]
    assert got == [r["id"] for r in df.where("k = 0").orderBy("v", "id").collect()]
    small = spark.range(5).select(F.lit(0).cast("bigint").alias("k"), F.col("id").alias("w"))
    assert salted_join(df, small, ["k"], F.col("id")).count() == df.where("k = 0").count() * 5


def test_overlap_counts_against_pairs(spark):
    rng = random.Random(11)
    rows = [(0 if i % 3 else 1, i, s := rng.randrange(60), s + rng.randrange(12)) for i in range(200)]
    got = {r["r"]: r["n_overlaps"] for r in iv.overlap_counts(spark.createDataFrame(rows, "k int, r int, from_ix int, to_ix int"), "k", "r", 3).collect()}
    for k, r, a, b in rows:
        n = sum(1 for k2, r2, c, e in rows if k2 == k and r2 != r and min(b, e) - max(a, c) + 1 >= 3)
        assert got.get(r, 0) == n


def test_near_duplicates_against_pairs(spark):
    rng = random.Random(2)
    vocab = [f"word{c}{x}" for c in "abcdef" for x in "ghij"]
    base = [rng.sample(vocab, 8) for _ in range(12)]
    rows = []
    for i in range(80):
        w = list(rng.choice(base))
        if rng.random() < 0.6:
            w[rng.randrange(8)] = rng.choice(vocab)
        rows.append((i % 3, i, " ".join(w)))
    got = {(r["doc"], r["line_ix"]): (r["partner_ix"], r["kind"]) for r in lk.near_duplicate_lines(spark.createDataFrame(rows, "doc int, ix int, line string"), "doc", "ix", "line").where("kind = 'near'").collect()}
    firsts = {}
    for d, i, l in rows:
        firsts.setdefault((d, l), i)
    letters = lambda l: {"".join(c for c in w if c.isalpha()) for w in l.split()}
    want = {}
    for (d, l), i in firsts.items():
        near = [j for (d2, m), j in firsts.items() if d2 == d and j < i and min(len(letters(l)), len(letters(m))) >= 5 and len(letters(l) & letters(m)) * 10 >= len(letters(l) | letters(m)) * 8]
        if near:
            want[(d, i)] = (min(near), "near")
    assert got == want


def test_carried_days_of_skipped_sources_and_missing_runs(spark):
    from dossierflow.operators import listings as ls
    rng = random.Random(8)
    good = {(s, d) for s in range(6) for d in range(1, 29) if rng.random() < 0.25}
    runs, skipped = {d for d in range(1, 29) if d % 6}, {(s, d) for s in range(6) for d in range(1, 29) if rng.random() < 0.1}
    wanted = set()
    for s in range(6):
        for d in runs:
            back = [x for x in range(max(1, d - 7), d) if (s, x) in good]
            if (s, d) not in good and (s, d) not in skipped and back:
                wanted.add((s, d, max(back)))
    day = lambda rows, names: spark.createDataFrame(rows, names).withColumn("day", F.make_date(F.lit(2024), F.lit(1), F.col("n").cast("int"))).drop("n")
    got = ls.carried_days(day(sorted(good), "source int, n int"), day([(d,) for d in runs], "n int"), "source", "day", 7, day(sorted(skipped), "source int, n int")).collect()
    assert {(r["source"], r["day"].day, r["stale_since"].day) for r in got} == wanted and len(got) == len(wanted)
