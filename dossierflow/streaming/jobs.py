"""Structured Streaming jobs over messages and events."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierflow.operators.intervals import bucketed_last, trailing_rate
from dossierflow.operators.scale import shared_folder

WATERMARK = "2 days"


def dedupe_stream(messages: DataFrame, key: str, ts: str, delay: str = WATERMARK) -> DataFrame:
    """Drop repeats of a key that arrive within the watermark; state is bounded by it."""
    return messages.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


class _Window:
    """Times of accepted requests of one key inside the window; at most ``n`` are kept."""

    def __init__(self, n: int, width: int, times: list[int] | None = None):
        self.n, self.width, self.times = n, width, list(times or [])

    def admit(self, t: int) -> bool:
        self.times = [x for x in self.times if t - x < self.width]
        if len(self.times) >= self.n:
            return False
        self.times.append(t)
        return True


def admit_batch(events: DataFrame, key: str, ts: str, ident: str, n: int, seconds: int) -> DataFrame:
    """Sliding-window limiter that counts accepted requests only, over a table.

    A pause of a whole window empties the limiter, so a key is cut at its pauses and its segments run on
    different tasks; inside a segment rows stream through in time order and only ``n`` times are held."""
    width = seconds * 1_000_000
    marked = (trailing_rate(events.select(key, ts, ident), [key], ts, ident, n, seconds, with_opening=True)
              .withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))))
    opening = F.when(F.col("opening"), F.col("_t"))
    seg = bucketed_last(marked, [key], "_t", opening, "_prev", span=width * 64)
    rows = (seg.withColumn("_seg", F.coalesce(opening, F.col("_prev"))).select(key, ident, "_t", "_seg")
            .repartition(F.col(key), F.col("_seg")).sortWithinPartitions(key, "_seg", "_t", ident))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, window = None, _Window(n, width)
        for pdf in batches:
            accepted = []
            for k, s, t in zip(pdf[key], pdf["_seg"], pdf["_t"]):
                if (k, s) != current:
                    current, window = (k, s), _Window(n, width)
                accepted.append(window.admit(int(t)))
            yield pd.DataFrame({key: pdf[key], ident: pdf[ident], "accepted": accepted})

    types = dict(events.dtypes)
    return rows.mapInPandas(run, f"`{key}` {types[key]}, `{ident}` {types[ident]}, accepted boolean")


def admit_stream(events: DataFrame, key: str, ts: str, ident: str, n: int, seconds: int, delay: str = "10 minutes") -> DataFrame:
    """The same limiter on a stream; per key the state is the accepted times inside the window, expired by event time."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
    width = seconds * 1_000_000
    types = dict(events.dtypes)

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        window = _Window(n, width, list(state.get[0]) if state.exists else None)
        # a key's rows of one trigger come in several Arrow chunks; order is over all of them
        pdf = pd.concat(list(batches)).sort_values(["_t", ident])
        yield pd.DataFrame({key: pdf[key], ident: pdf[ident], "accepted": [window.admit(int(t)) for t in pdf["_t"]]})
        state.update((window.times,))
        last = max(window.times, default=0) + width
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs() + 1))

    rows = events.withWatermark(ts, delay).withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    return rows.groupBy(key).applyInPandasWithState(
        run, f"`{key}` {types[key]}, `{ident}` {types[ident]}, accepted boolean", "times array<bigint>", "append",
        GroupStateTimeout.EventTimeTimeout)


def refresh_available(spark: SparkSession, landed: str, schema, sink: Callable[[DataFrame, int], None], checkpoint: str | None = None):
    """Scheduled collection: everything that landed since the last run goes to ``sink`` once, then the job ends.
    Progress is kept in ``checkpoint``, by default in the shared folder that the session names."""
    where = checkpoint or f"{shared_folder(spark)}/refresh"
    return (spark.readStream.schema(schema).parquet(landed).writeStream.foreachBatch(sink)
            .option("checkpointLocation", where).trigger(availableNow=True).start())


def incremental_since(messages: DataFrame, ts: str, since, key: str) -> DataFrame:
    """Read from the horizon on, with repeats of the overlap dropped."""
    return messages.where(F.col(ts) >= since).dropDuplicates([key])
