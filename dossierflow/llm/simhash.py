"""SimHash near-duplicates (operator 7): candidates by chains of segments on a ring, links by the full distance.

The 64 bits are cut into three segments on a ring. If two fingerprints differ in at most 2 bits, there is a segment from which every
chain of 1, 2, 3 consecutive segments differs in at most 1, 2, 3 times 2/3 bits: in no bit, at most one, at most two. So a pair agrees on
some segment and differs by at most one bit in it and the next together. That chain of two segments (43 or 42 bits) is the key
under which pairs meet: exact, or with one bit of its second half turned. Only what meets there gets the full check.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierflow.llm.shared import filled, stored

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Hashes that are counted at once, and group sizes whose pairs are compared all in one step.
CHUNK, SMALL_GROUP = 1 << 16, 8


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits; a bit is set if it is set in more than half of the shingles' hashes. A-Z are lower-cased, words are parted by ASCII white
    space, fewer than ``size`` words are one shingle, and no word gives 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    first, last = first[:n].tolist(), ends[min(size, len(words)) - 1:].tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, CHUNK):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(first[i:i + CHUNK], last[i:i + CHUNK])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, digest`` (a hash of the text, to tell rows of one id apart) and ``fp``."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([fingerprint(t, size, seed) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fp], names=["doc_id", "digest", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("digest"), filled(text).cast("binary").alias("t"))
    return rows.mapInArrow(mark, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, digest long, fp long")


def chain_keys(fps: DataFrame) -> DataFrame:
    """``segment, key, turned, fp``: for each segment the chain of it and the next, as it is and with one bit of the next turned.

    The pair's side whose bit is 0 turns it, so each pair meets once per segment."""
    def mask(first: int, width: int) -> int:
        return ((1 << width) - 1) << first

    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    fp, rows = F.col("fp"), []
    for s, own in enumerate(SEGMENTS):
        following = SEGMENTS[(s + 1) % len(SEGMENTS)]
        key = fp.bitwiseAND(F.lit(signed(mask(*own) | mask(*following))))
        bits = F.array(*[F.lit(signed(1 << b)) for b in range(following[0], sum(following))])
        turned = F.transform(F.filter(bits, lambda b: fp.bitwiseAND(b) == 0),
                             lambda b: F.struct(F.lit(s).alias("segment"), key.bitwiseOR(b).alias("key"), F.lit(1).alias("turned")))
        rows.append(F.concat(F.array(F.struct(F.lit(s).alias("segment"), key.alias("key"), F.lit(0).alias("turned"))), turned))
    return fps.select("fp", F.explode(F.concat(*rows)).alias("r")).select("r.segment", "r.key", "r.turned", "fp")


def group_links(key: np.ndarray, turned: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside groups of equal keys (rows sorted by key, exact ones first): for a small group all of them, for a larger one a
    set that connects the same fingerprints."""
    border = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    size = np.diff(border)
    use = (size > 1) & (turned[border[:-1]] == 0)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    begin, n = border[:-1][use & (size <= SMALL_GROUP)], size[use & (size <= SMALL_GROUP)]
    for i in range(SMALL_GROUP):
        for j in range(i + 1, SMALL_GROUP):
            at = begin[n > j]
            close = (turned[at + i] == 0) & (np.bitwise_count((fp[at + i] ^ fp[at + j]).view(np.uint64)) <= DISTANCE)
            a.append(fp[at + i][close])
            b.append(fp[at + j][close])
    for start, n in zip(border[:-1][use & (size > SMALL_GROUP)].tolist(), size[use & (size > SMALL_GROUP)].tolist()):
        rest = np.unique(fp[start:start + n])
        while len(rest):
            reached, rest = [rest[0]], rest[1:]
            while reached and len(rest):
                node = reached.pop()
                close = np.bitwise_count((rest ^ node).view(np.uint64)) <= DISTANCE
                new, rest = rest[close], rest[~close]
                a.append(np.full(len(new), node))
                b.append(new)
                reached += list(new)
    return np.concatenate(a), np.concatenate(b)


def links(fps: DataFrame) -> DataFrame:
    """``a, b`` (a < b): links between different fingerprints, enough of them to connect all that are linked. ``fps`` is distinct."""
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            own = [batch.column(c).to_numpy() for c in range(4)]
            own = own if kept is None else [np.concatenate(x) for x in zip(kept, own)]
            if not len(own[0]):
                continue
            last = (own[0] != own[0][-1]) | (own[1] != own[1][-1])  # the last group may go on in the next batch
            cut = int(last.nonzero()[0][-1]) + 1 if last.any() else 0
            kept = [x[cut:] for x in own]
            yield linked(*(x[:cut] for x in own))
        if kept is not None:
            yield linked(*kept)

    def linked(segment: np.ndarray, key: np.ndarray, turned: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        found = [group_links(key[segment == s], turned[segment == s], fp[segment == s]) for s in range(len(SEGMENTS)) if (segment == s).any()]
        a, b = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    dealt = chain_keys(fps).repartition("segment", "key").sortWithinPartitions("segment", "key", "turned")
    return dealt.mapInArrow(meet, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the least node that each linked node reaches. Large and small stars in turn: every step links nodes to the least
    of their neighbours, by aggregations and joins whose hot sides are split, until nothing changes."""
    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, now = None, state(edges)
    while before != now:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        before, now = now, state(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, fingerprint, component_id, digest`` of every row. Rows are linked if their fingerprints differ in at most two bits;
    ``component_id`` is the smallest id that links reach, the row's own included.

    Equal fingerprints are one node, so copies cost one row each. A null text is an empty one and has fingerprint 0, as has any text
    without a word; these are linked like others. A null id is never the smallest unless all of its component are null. Repeated rows give
    repeated results, an empty table none, and further columns are left out."""
    rows = stored(fingerprints(docs, doc_id, text, size, seed), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp")))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return (rows.join(named, "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "digest"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, null ids last; of rows that share it the one with the smallest
    hash of its text; of equal rows one."""
    found = near_duplicates(docs, doc_id, text, **options)
    # a component without an id is told apart by its fingerprints' least one, which is the same for all copies
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fingerprint")))
    best = found.groupBy(group).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("best")).select(
        F.col("best.doc_id").alias("_id"), F.col("best.digest").alias("_digest"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("_own"), F.xxhash64(text).alias("_text"))
    kept = packed.join(best, packed["_own"].eqNullSafe(best["_id"]) & (packed["_text"] == best["_digest"]), "left_semi")
    return kept.groupBy("_own", "_text").agg(F.first("row").alias("row")).select("row.*")
