"""Mixing sources to target weights (operator 12): blocks of words, multinomial draws per output shard, permuted indices.

Each source's documents, in a pseudorandom order, make one stream that is cut into blocks of equal length. The output is shards of
slots, a block each. Every shard draws how many of its slots each source gets (multinomial, by the sources' shares of the whole).
A source's slots are numbered over all shards, and a pseudorandom permutation of its block indices, another one in each pass over the
source, says which block a slot takes; slots and blocks then meet by index.

Draws miss the targets by about the root of the number of slots. The few slots that a source draws beyond its quota, chosen by a
permutation too, go to the sources that drew fewer, so the mix as a whole meets every quota and no block is taken more often than the
passes allow. The last slot of a source takes only as many words as its target still lacks.
"""
from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossierflow.llm.shared import before_parts, stored

#: Words of a block, blocks of a shard, and how often a source may be taken.
BLOCK_WORDS, SHARD_SLOTS, MOST_TIMES = 2048, 1024, 3
WEIGHTS = (5, 2, 1)
#: Shards whose slots one task numbers, about.
TASK_SHARDS = 16
WORD = r"[^\x20\x09-\x0D]+"
#: Sources whose names and sizes may reach the driver; a mix by hand-written weights has far fewer.
MOST_SOURCES = 100_000
#: Documents of a stream that one task puts in order, about; and equal rows that are written out at once.
RUN, COPIES = 512, 4096


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> list[Fraction]:
    """Exact targets of sources in their order: shares of all sizes by the weights, repeating; at most ``most`` times a source's own size,
    the excess shared again by weight among the others until none is above."""
    share = [Fraction(weights[i % len(weights)]) for i in range(len(sizes))]
    found, left, free = [Fraction(0)] * len(sizes), Fraction(sum(sizes)), set(range(len(sizes)))
    while free and left:
        level = left / sum(share[i] for i in free)
        full = [i for i in free if share[i] * level > most * sizes[i]]
        for i in full or free:
            found[i] = Fraction(most * sizes[i]) if full else share[i] * level
        left -= sum(found[i] for i in full)
        free = free - set(full) if full else set()
    return found


def mixed_up(values: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers (the finaliser of a public 64-bit mixer; its constants are fixed values)."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def permuted(values: np.ndarray, n: int, key: np.ndarray | int) -> np.ndarray:
    """Pseudorandom permutation of 0 to n - 1 for each key: a Feistel network of four rounds over the next even power of two, walked on
    until it falls below n."""
    half = np.uint64(max(1, (int(n - 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    out = values.astype(np.uint64)
    keys = np.broadcast_to(np.asarray(key, np.uint64), out.shape)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & low
        for r in range(4):
            with np.errstate(over="ignore"):
                turn = mixed_up(keys[todo] + right * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r))
            left, right = right, left ^ (turn & low)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


class Plan:
    """What the draws need, by source in order of its name: numbers of blocks and slots, words of the last slot."""

    def __init__(self, names: list, sizes: list[int], block: int, weights: tuple[int, ...], most: int, seed: int):
        self.names, self.sizes, self.block, self.seed = names, sizes, block, seed
        self.targets = targets(sizes, weights, most)
        self.blocks = [-(-s // block) for s in sizes]
        quotas = [self.quota(i, int(t + Fraction(1, 2))) for i, t in enumerate(self.targets)]
        self.slots, self.last = [q[0] for q in quotas], [q[1] for q in quotas]

    def key(self, source: int, use: int) -> int:
        """Key of a source's permutation number ``use``: 0 for its slots, from 1 on for its passes."""
        return int(mixed_up(mixed_up(np.array([self.seed * 1_000_003 + source + 2], np.uint64)) + np.uint64(use))[0])

    def quota(self, i: int, words: int) -> tuple[int, int]:
        """Slots that give ``words`` words of source ``i``, and the words of the last of them.

        All blocks are full but the source's last one, which may stand anywhere in a pass."""
        size, n = self.sizes[i], self.blocks[i]
        if not words:
            return 0, 0
        passes, rest = divmod(words - 1, size)
        rest += 1  # words from the last pass, 1 to size
        tail = size - (n - 1) * self.block
        at = unpermuted(n - 1, n, self.key(i, passes + 1))  # place of the short block in the last pass
        if rest <= at * self.block:
            slots = -(-rest // self.block)
            return passes * n + slots, rest - (slots - 1) * self.block
        if rest <= at * self.block + tail:
            return passes * n + at + 1, rest - at * self.block
        rest -= at * self.block + tail
        slots = -(-rest // self.block)
        return passes * n + at + 1 + slots, rest - (slots - 1) * self.block


def unpermuted(value: int, n: int, key: int) -> int:
    """The number that ``permuted`` takes to ``value``."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    low, out = (1 << half) - 1, value
    while True:
        left, right = out >> half, out & low
        for r in reversed(range(4)):
            before = left
            turn = int(mixed_up(np.array([(key + before * 0x9E3779B97F4A7C15 + r) & (1 << 64) - 1], np.uint64))[0])
            left, right = right ^ (turn & low), before
        out = (left << half) | right
        if out < n:
            return out


def stream(docs: DataFrame, seed: int, doc_id: str, text: str, source: str) -> DataFrame:
    """Documents in their sources' streams: ``source, doc_id, digest, copy, size, begin``, stored; ``copy`` tells equal rows apart.

    The order is that of a hash of id, text and copy, so it does not depend on how rows are dealt. It is made inside runs of about
    ``RUN`` rows by the hash's leading bits, and the runs' sizes are added up."""
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(source).cast("string").alias("source"), F.col(doc_id).alias("doc_id"), F.sha2(text, 256).alias("digest"), words.alias("size"))
    alike = stored(rows.groupBy("source", "doc_id", "digest", "size").agg(F.count(F.lit(1)).alias("n")), "mix-documents")
    many = F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") - 1)))
    # a large number of equal rows is dealt out in portions before it is written out row by row
    portions = (alike.where(F.col("n") > COPIES)
                .select("source", "doc_id", "digest", "size", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))).alias("p"))
                .repartition("source", "doc_id", "digest", "p")
                .select("source", "doc_id", "digest", "size", F.explode(F.sequence("p", F.least(F.col("n"), F.col("p") + COPIES) - 1)).alias("copy")))
    each = alike.where(F.col("n") <= COPIES).select("source", "doc_id", "digest", "size", many.alias("copy")).unionByName(portions)
    total = alike.agg(F.sum("n")).first()[0] or 0
    bits = max(0, (total // RUN).bit_length())
    h = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("digest", F.lit("null")), "copy")
    placed = each.withColumn("h", h).withColumn("run", F.shiftrightunsigned(F.col("h"), 64 - bits) if bits else F.lit(0).cast("long"))
    name = F.concat(F.lit("="), F.col("source"))
    placed = placed.withColumn("key", F.coalesce(name, F.lit("-")))
    order = W.partitionBy("key", "run").orderBy("h", "doc_id", "digest", "copy").rowsBetween(W.unboundedPreceding, -1)
    inside = placed.withColumn("inside", F.coalesce(F.sum("size").over(order), F.lit(0)))
    runs = placed.groupBy("key", "run").agg(F.sum("size").alias("size"))
    found = (inside.join(before_parts(runs, ["key"], "run", "size"), ["key", "run"])
             .select("key", "source", "doc_id", "digest", "copy", "size", (F.col("before") + F.col("inside")).alias("begin")))
    return stored(found, "mix-streams")


def plan_of(streams: DataFrame, block: int, weights: tuple[int, ...], most: int, seed: int) -> Plan:
    """Sizes of all sources, in order of code points, null last. One row per source reaches the driver; more than ``MOST_SOURCES`` of them
    stop the job."""
    sizes = (streams.groupBy("source").agg(F.sum("size").alias("size")).orderBy(F.col("source").asc_nulls_last()).limit(MOST_SOURCES + 1).collect())
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources to mix")
    return Plan([r["source"] for r in sizes], [r["size"] for r in sizes], block, weights, most, seed)


def drawn_slots(spark, plan: Plan, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``shard, slot, source_at, block, take``: the block of each slot and how many of its words it takes."""
    total = sum(plan.slots)
    shards = -(-total // shard_slots)
    share = np.array([s / total for s in plan.slots]) if total else np.zeros(0)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"].tolist():
                n = min(shard_slots, total - shard * shard_slots)
                counts = np.random.Generator(np.random.Philox(key=[plan.seed, shard])).multinomial(n, share)
                own = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": shard, "source_at": own, "n": counts[own], "inside": np.cumsum(counts[own]) - counts[own]})

    counts = stored(spark.range(shards).mapInPandas(draw, "shard long, source_at long, n long, inside long"), "mix-draws")
    drawn = [0] * len(plan.slots)
    for r in counts.groupBy("source_at").agg(F.sum("n").alias("n")).collect():  # one row per source
        drawn[r["source_at"]] = r["n"]
    over = [max(0, d - q) for d, q in zip(drawn, plan.slots)]
    over_first = np.cumsum([0, *over])
    lacking = [max(0, q - d) for d, q in zip(drawn, plan.slots)]
    lack_first = np.cumsum([0, *lacking])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, s, n, inside, before in zip(*(c.to_pylist() for c in batch.columns)):
                slots = min(shard_slots, total - shard * shard_slots)
                slot = permuted(np.arange(inside, inside + n), slots, plan.key(-1, shard + 1))
                i = permuted(np.arange(before, before + n), drawn[s], plan.key(s, 0))
                source = np.full(n, s)
                spare = np.flatnonzero(i >= plan.slots[s])
                if len(spare):  # drawn beyond the quota: the slot goes to a source that drew too few
                    place = over_first[s] + i[spare] - plan.slots[s]
                    source[spare] = np.searchsorted(lack_first, place, "right") - 1
                    i[spare] = np.array(drawn)[source[spare]] + place - lack_first[source[spare]]
                block, take = np.zeros(n, np.int64), np.full(n, plan.block)
                for t in np.unique(source).tolist():
                    own = np.flatnonzero(source == t)
                    passes, at = np.divmod(i[own], plan.blocks[t])
                    for p in np.unique(passes).tolist():
                        block[own[passes == p]] = permuted(at[passes == p], plan.blocks[t], plan.key(t, p + 1))
                    take[own[i[own] == plan.slots[t] - 1]] = plan.last[t]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(slot), pa.array(source), pa.array(block), pa.array(take)],
                                                 names=["shard", "slot", "source_at", "block", "take"])

    numbered = counts.join(before_parts(counts.select("source_at", "shard", "n"), ["source_at"], "shard", "n"), ["source_at", "shard"])
    return numbered.select("shard", "source_at", "n", "inside", "before").repartition(-(-max(1, shards) // TASK_SHARDS), "shard").mapInArrow(
        index, "shard long, slot long, source_at long, block long, take long")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS,
        weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES, seed: int = 12) -> tuple[DataFrame, DataFrame, Plan]:
    """The mix as pieces, the documents' streams and the plan.

    Pieces: ``shard, slot, at`` (words of the slot before it)``, source, doc_id, digest, copy, start, length``: the words ``start`` to
    ``start + length`` of the document with that id and SHA-256 of its text. Reading them in order of shard, slot and ``at`` gives the mix.

    A null text has no words, a null source is the last one, null ids are kept; rows that are equal in source, id and text count each, told
    apart by ``copy``. An empty table gives no pieces. Other columns are left out. Documents without words are never taken."""
    streams = stream(docs, seed, doc_id, text, source)
    plan = plan_of(streams, block, weights, most, seed)
    spark = docs.sparkSession
    slots = stored(drawn_slots(spark, plan, shard_slots), "mix-slots")
    named = spark.createDataFrame([("-" if n is None else "=" + n, i) for i, n in enumerate(plan.names)], "key string, source_at long")
    first, last = F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block)
    whole = (streams.where(F.col("size") > 0).join(F.broadcast(named), "key")  # at most MOST_SOURCES rows
             .select("source_at", "source", "doc_id", "digest", "copy", "size", "begin", F.explode(F.sequence(first, last)).alias("block")))
    begin = F.greatest(F.lit(0), F.col("begin") - F.col("block") * block)
    end = F.least(F.col("take"), F.col("begin") + F.col("size") - F.col("block") * block)
    pieces = (slots.join(whole, ["source_at", "block"])
              .select("shard", "slot", begin.alias("at"), "source", "doc_id", "digest", "copy",
                      F.greatest(F.lit(0), F.col("block") * block - F.col("begin")).alias("start"), (end - begin).alias("length"))
              .where(F.col("length") > 0))
    return pieces, streams, plan


def taken_report(pieces: DataFrame, streams: DataFrame, plan: Plan) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row."""
    spark = pieces.sparkSession
    named = spark.createDataFrame([("-" if n is None else "=" + n, s, float(t)) for n, s, t in zip(plan.names, plan.sizes, plan.targets)],
                                  "key string, source_size long, target double")
    own = pieces.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")).alias("key"), "doc_id", "digest", "copy", F.col("length").alias("taken"))
    sizes = streams.select("key", "doc_id", "digest", "copy", "size", F.lit(0).cast("long").alias("taken"))
    found = (own.withColumn("size", F.lit(0).cast("long")).unionByName(sizes).groupBy("key", "doc_id", "digest", "copy")
             .agg(F.sum("size").alias("size"), F.sum("taken").alias("taken")))
    return found.join(F.broadcast(named), "key").select("doc_id", "size", "source_size", "target", "taken")  # at most MOST_SOURCES rows
