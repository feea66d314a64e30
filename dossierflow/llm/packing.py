"""Best-fit packing (operator 2): the plan is made for the counts of each length, documents find their places by rank.

Pieces of one length are alike to a packer. There are at most ``capacity`` lengths, so the plan of a corpus of any size is worked
out from that many counts, and a place in it is a run of ranks: *the pieces of this length with ranks from r to r + n lie at this
offset of the sequences from s to s + n*.
"""
from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierflow.llm import tokens
from dossierflow.llm.shared import before_parts, filled, stored

CAPACITY = 2048


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs ``(length, rank, n, sequence, offset)`` that place ``counts[length]`` pieces of every length.

    Of pieces above a third of the capacity at most two share a sequence. They are matched greedily, the longest first with the
    longest partner that fits. Shorter ones then go, the longest first, each into the smallest gap that holds it, and a new
    sequence opens only where no gap does. Equal sequences are handled together, whatever their number."""
    left, rank, runs, opened = dict(counts), defaultdict(int), [], 0
    gaps: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # gap: (first sequence, how many, used)

    def place(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, rank[length], n, first, offset))
        rank[length] += n
        left[length] -= n

    large = sorted(x for x in left if 3 * x > capacity)
    for a in reversed(large):
        while left[a]:
            b = next((large[i] for i in range(bisect_right(large, min(a, capacity - a)) - 1, -1, -1)
                      if left[large[i]] > (large[i] == a)), None)
            n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
            place(a, n, opened, 0)
            if b is not None:
                place(b, n, opened, a)
            used = a + (b or 0)
            gaps[capacity - used].append((opened, n, used))
            opened += n
    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[length]:
            gap = next((g for g in range(length, capacity) if gaps.get(g)), capacity)
            first, n, used = gaps[gap].pop() if gap < capacity else (opened, 1 + (left[length] - 1) // (capacity // length), 0)
            opened += n if gap == capacity else 0
            each = min(gap // length, left[length])
            filled_up = min(n, left[length] // each)
            for j in range(each):
                place(length, filled_up, first, used + j * length)
            gaps[gap - each * length].append((first, filled_up, used + each * length))
            if filled_up < n:
                gaps[gap].append((first + filled_up, n - filled_up, used))
    return runs


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, doc_id: str = "doc_id", text: str = "text",
                 with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every document, with the end id: ``doc_id, piece, start, length, ids_crc32``, the
    place of its task (``part``) and its rank among equal lengths there (``nth``). Only longer documents are cut; their first piece
    is the shorter one."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
              ("part", pa.int64()), ("nth", pa.int64())] + [("ids", pa.binary())] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, seen = tokens.id_table(tokenizer), TaskContext.get().partitionId(), defaultdict(int)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, keys = [], iter(batch.column(0).to_pylist())
            for flat, sizes in table.texts(batch.column(1).to_pylist()):
                raw, at = flat.tobytes(), 0
                for size in sizes.tolist():
                    key, ids = next(keys), raw[4 * at:4 * (at + size)] + end
                    at += size
                    borders = [0, *range(size % capacity + 1, size + 2, capacity)]
                    for k, (a, b) in enumerate(zip(borders, borders[1:])):
                        own = ids[4 * a:4 * b]
                        rows.append((key, k, a, b - a, zlib.crc32(own), part, seen[b - a]) + ((own,) if with_ids else ()))
                        seen[b - a] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

    rows = docs.select(F.col(doc_id).cast("long").alias("k"), filled(text).alias("t"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"
                           + ", ids binary" * with_ids)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Places of pieces with ``length, part, nth``: adds ``sequence_id, offset`` and drops ``part, nth``.

    ``pieces`` must be stored, since it is read twice. Only the counts per length reach the driver (at most ``capacity`` rows)."""
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    runs = plan({r["length"]: r["n"] for r in counts.collect()}, capacity)
    runs.sort()
    places = pieces.sparkSession.sparkContext.broadcast(np.array(runs, np.int64).reshape(-1, 5))
    sizes = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    ranked = (pieces.join(before_parts(sizes, ["length"], "part", "n"), ["length", "part"])
              .withColumn("rank", F.col("before") + F.col("nth")))
    out = [c for c in pieces.columns if c not in ("part", "nth")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (batch.column("length").to_numpy() << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in out] + [pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])],
                                             names=[*out, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in out)
    return ranked.select(*out, "rank").mapInArrow(find, f"{schema}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Every document's pieces with their sequence and offset; sequences have no gaps from 0 on.

    Ids are whole numbers of 64 bits; a text id that is no number stops the job. A null text is empty (one piece, the end id), a null id stays null, repeated rows are packed each, an empty table gives none, and
    further columns are left out. Which of equally long pieces goes where depends on the parts of the input."""
    return pack(stored(token_pieces(docs, tokenizer, capacity, end_id, with_ids=with_ids), "pieces"), capacity)
