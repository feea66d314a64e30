"""Messages into records as one stateful stream.

State per record: its fields, and the keys of the messages it has read with what became of each, in blocks of a bounded size: one trigger reads and
writes the blocks that its messages fall in, not one key at a time. A message read before is a duplicate, unless it
was left unmatched or set aside: then it is read again. A sent copy sets a timer; if no answer has come when it fires, a follow-up is due, and
keys older than the horizon are forgotten. The state begins with the last snapshot of the records. Changed records go to a sink that
keeps one folder per batch id, so a batch that runs again replaces itself.
"""
from __future__ import annotations

import datetime
import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from dossierflow.operators.ledger import FIELDS, UNSENT, step

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Days without an answer before a follow-up, and days that message keys are remembered.
FOLLOW_UP, REMEMBERED = 4, 180
DAY = 86_400_000
#: Keys of a block, on average; a record's blocks are doubled when they hold more.
BLOCK = 64
TEXT = StringType()


def schema(key: str, names: tuple[str, ...]) -> StructType:
    return StructType([StructField(n, TEXT) for n in (key, *names)])


def applied(state: dict, way: str, cls: str, day: str | None) -> dict:
    """A record's fields after one message (days as ISO text)."""
    now = dict(state)
    if way == "out":
        unsent = state["stage"] in UNSENT
        if day and (unsent or not state["sent"] or day < state["sent"]):
            now["sent"] = day
        now["stage"] = step(state["stage"], "sent")
        return now
    if day and cls != "read" and (not state["last_inbound"] or day > state["last_inbound"]):
        now["last_inbound"] = day
    if day and cls == "read" and (not state["opened"] or day < state["opened"]):
        now["opened"] = day
    if state["stage"] == "prepared" and not state["sent"]:
        now["sent"] = state["prepared"] or day
    now["stage"] = step(state["stage"], cls)
    return now


class RecordTracker(StatefulProcessor):
    """Rows in: key, message, dir, cls, day, decision, at (milliseconds). Rows out: key, kind (``record`` or ``due``) and the fields."""

    def __init__(self, follow_up: int = FOLLOW_UP, remembered: int = REMEMBERED):
        self.follow_up, self.remembered = follow_up, remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # beside the fields: number of blocks, of keys, and a day that no key is older than
        self.record = handle.getValueState("record", schema("stage", ("sent", "last_inbound", "opened", "prepared", "blocks", "keys", "oldest")))
        self.seen = handle.getMapState("blocks", schema("block", ()), schema("keys", ()))

    def held(self) -> tuple[dict, int, int, str | None]:
        """The record's fields, its number of blocks and of keys, and the day that no key is older than."""
        names = ("stage", "sent", "last_inbound", "opened", "prepared")
        stored = self.record.get()
        if stored is None:
            return dict.fromkeys(names) | {"stage": "none"}, 1, 0, None
        return dict(zip(names, stored)), int(stored[5]), int(stored[6]), stored[7]

    def block(self, number: str) -> dict:
        """Message keys of a block with status and day."""
        found = self.seen.getValue((number,))
        return {m: (status, day) for m, status, day in json.loads(found[0])} if found else {}

    def store(self, number: str, keys: dict) -> None:
        self.seen.updateValue((number,), (json.dumps([(m, *v) for m, v in keys.items()]),))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.astype(object).where(initialState.notna(), None).iloc[0]
        self.record.update((row["stage"] or "none", row["sent"], row["last_inbound"], row["opened"], row["prepared"], "1", "0", None))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before, blocks, n, oldest = self.held()
        state = before
        # a record's messages of one trigger, in order of time; the trigger's size bounds them
        batch = pd.concat(list(rows)).sort_values(["at", "message"])
        batch = batch.astype(object).where(batch.notna(), None).to_dict("records")
        touched, changed, days, fresh = {}, set(), set(), 0
        for r in batch:
            number = place(r["message"], blocks)
            if number not in touched:
                touched[number] = self.block(number) if n else {}
            keys = touched[number]
            known = keys.get(r["message"])
            if known and known[0] not in ("unmatched", "ignored"):
                continue
            fresh += r["message"] not in keys
            keys[r["message"]] = r["decision"], r["day"]
            changed.add(number)
            if r["day"]:
                oldest = min(oldest or r["day"], r["day"])
            if r["decision"] != "auto":
                continue
            state = applied(state, r["dir"], r["cls"], r["day"])
            if r["dir"] == "out" and r["day"]:
                days.add(r["day"])
        if changed:
            blocks = self.write(blocks, n, n + fresh, {b: touched[b] for b in changed})
        if changed or state != before:
            self.keep(state, blocks, n + fresh, oldest)
        for day in sorted(days):
            self.handle.registerTimer(milliseconds(day) + self.follow_up * DAY)
        if state != before:
            yield self.row(key, "record", state)

    def write(self, blocks: int, n: int, total: int, changed: dict) -> int:
        """Writes the changed blocks; where keys are too many for them, all are dealt out anew over two times as many, or more. Returns how many."""
        wide = blocks
        while total > BLOCK * wide:
            wide *= 2
        if wide > blocks:
            old = {number: self.block(number) for number in map(str, range(blocks)) if n and number not in changed}
            dealt = {number: {} for number in map(str, range(wide))}
            for keys in (*old.values(), *changed.values()):
                for message, value in keys.items():
                    dealt[place(message, wide)][message] = value
            changed = dealt
        for number, keys in changed.items():
            self.store(number, keys)
        return wide

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (state, blocks, n, oldest), now = self.held(), expiredTimerInfo.getExpiryTimeInMs()
        horizon = datetime.datetime.fromtimestamp(now / 1000 - self.remembered * 86400, datetime.UTC).date().isoformat()
        if oldest and oldest < horizon:
            n, oldest = 0, None
            for (number,), (text,) in list(self.seen.iterator()):
                keys = json.loads(text)
                kept = {m: (status, day) for m, status, day in keys if not day or day >= horizon}
                if len(kept) < len(keys):
                    self.store(number, kept)
                n, oldest = n + len(kept), min((d for d in (oldest, *(day for _, day in kept.values())) if d), default=None)
            self.keep(state, blocks, n, oldest)
        if state["sent"] and not state["last_inbound"] and milliseconds(state["sent"]) + self.follow_up * DAY <= now:
            yield self.row(key, "due", state)

    def keep(self, state: dict, blocks: int, n: int, oldest: str | None) -> None:
        self.record.update((*state.values(), str(blocks), str(n), oldest))

    def row(self, key, kind: str, state: dict) -> pd.DataFrame:
        return pd.DataFrame({"key": [str(key[0])], "kind": [kind], **{f: [state[f]] for f in FIELDS}})

    def close(self) -> None:
        pass


def place(message: str | None, blocks: int) -> str:
    return str(zlib.crc32((message or "").encode()) % blocks)


def milliseconds(day: str) -> int:
    return int(datetime.datetime.fromisoformat(day).replace(tzinfo=datetime.UTC).timestamp() * 1000)


def track(messages: DataFrame, records: DataFrame, key: str, ts: str, delay: str = "2 days", **options) -> DataFrame:
    """Changed records and due follow-ups of a stream: ``key, kind, stage, sent, last_inbound, opened`` (days as text).

    ``messages`` (a stream): key, message, dir, cls, decision and the time ``ts``. ``records`` (a table): key, stage, sent, last_inbound, opened,
    prepared. Messages of one trigger are applied in order of time; later triggers go on from the state. The session's state store must
    be RocksDB (``PROVIDER``)."""
    rows = messages.withWatermark(ts, delay).select(
        F.col(key).cast("string").alias("key"), "message", "dir", "cls", F.to_date(ts).cast("string").alias("day"), "decision",
        F.unix_millis(F.col(ts).cast("timestamp")).alias("at"), ts)
    start = records.select(F.col(key).cast("string").alias("key"), "stage", *[F.col(c).cast("string").alias(c) for c in ("sent", "last_inbound", "opened", "prepared")])
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=RecordTracker(**options), outputStructType=schema("key", ("kind", *FIELDS)), outputMode="Update", timeMode="EventTime",
        initialState=start.groupBy("key"))


def upsert_batches(folder: str):
    """A foreachBatch sink: the rows of batch n are the folder ``batch=n``, whole or not at all; a batch that runs again replaces its own."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return write


def latest(spark: SparkSession, folder: str, kind: str = "record") -> DataFrame:
    """The last state of each record that any batch changed."""
    rows = spark.read.option("basePath", folder).parquet(folder).where(F.col("kind") == kind)
    return rows.groupBy("key").agg(F.max_by(F.struct(*FIELDS), "batch").alias("r")).select("key", "r.*")


def run_available(messages: DataFrame, records: DataFrame, key: str, ts: str, folder: str, **options):
    """Read what has landed since the last run, then end. Progress, state and results lie below ``folder``."""
    messages.sparkSession.conf.set(PROVIDER, ROCKS)
    out = track(messages, records, key, ts, **options)
    return (out.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress").foreachBatch(upsert_batches(f"{folder}/records"))
            .trigger(availableNow=True).start())
