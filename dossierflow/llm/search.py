"""Ranked lexical search (operator 11): posting lists in geometric blocks with coordinatewise-maximum summaries, exact top k.

Documents are dealt to tasks and taken in chunks of bounded size. A chunk has a forward index (terms and their impacts by document) and
an inverted one. Each posting list is clustered by the similarity of its documents to pivot documents of that list; a cluster is a
block, and its summary has for every coordinate the greatest impact in the block. The summary's product with a query bounds the score of
every document of the block exactly, in whole numbers, so a block is skipped only if that bound is below what the query's k-th best
document is known to score. Lists of terms that cannot lift a document to that score even all together are not visited.

A term is a run of letters, digits and characters beyond ASCII, A-Z in lower case. A term found in a document ``tf`` times has the impact
w * (10^9 tf div (1000 tf + 8 m)), w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 25 + 75 n N div L.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, IntegerType, LongType, StructField, StructType

from dossierflow.llm.shared import dropped, stored

#: Results of a query.
TOP = 10
#: Characters of queries that are searched for at once (their terms are broadcast), and queries whose candidates are held at once.
QUERY_CHARS, QUERIES = 1 << 20, 256
#: Documents and postings of a chunk.
CHUNK_DOCS, CHUNK_POSTINGS = 16_384, 2 << 20
#: Pivots of a chunk, and documents of a block that are aimed at.
PIVOTS, BLOCK = 64, 32
#: Documents, about, whose scores give the first thresholds.
SAMPLE = 4096
#: Every byte that is no part of a term as a blank, A-Z in lower case.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


class Queries:
    """Queries of one block: ids, and for each its terms (numbers in the block's vocabulary) with their repeats."""

    def __init__(self, rows: list[tuple], first: int):
        self.first, self.ids, self.vocabulary, self.terms, self.repeats = first, [], {}, [], []
        for key, text in rows:
            counted = Counter(terms((text or "").encode("utf-8", "surrogatepass")))
            self.ids.append(key)
            self.terms.append(np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in counted], np.int64))
            self.repeats.append(np.array(list(counted.values()), np.int64))


def forward_index(docs: DataFrame, queries: Broadcast, doc_id: str, text: str) -> DataFrame:
    """``doc_id, n, terms, tf`` of documents with a term: all terms counted, those of the queries listed (32-bit numbers)."""
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = queries.value.vocabulary.get
        for batch in batches:
            rows = []
            for at, t in enumerate(batch.column(1).to_pylist()):
                words = terms(t)
                if words:
                    counted = Counter(map(number, words))
                    counted.pop(None, None)
                    rows.append((at, len(words), np.fromiter(counted, "<i4", len(counted)).tobytes(), np.fromiter(counted.values(), "<i4", len(counted)).tobytes()))
            at, n, own, tf = zip(*rows) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(n, pa.int64()), pa.array(own, pa.binary()),
                                              pa.array(tf, pa.binary())], names=["doc_id", "n", "terms", "tf"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("t")).where(F.col("t").isNotNull())
    return rows.mapInArrow(index, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, terms binary, tf binary")


def weights(forward: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Number of documents with a term, number of their terms, and the weight of each query term."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=size)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["term", "n"])

    n, length = forward.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = np.zeros(size, np.int64)
    for r in forward.select("terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # terms of the queries
        found[r["term"]] = r["n"]
    return n, length, np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for df in found.tolist()], np.int64)


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``n`` of them, one run after the other."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)


class Chunk:
    """Documents of one chunk: forward index, posting lists, and their similarity to the pivots."""

    def __init__(self, ids: list, first: np.ndarray, term: np.ndarray, impact: np.ndarray, size: int):
        self.ids, self.first, self.n, self.term, self.impact = ids, first[:-1], np.diff(first), term, impact
        order = np.argsort(term, kind="stable")
        self.list_docs = np.repeat(np.arange(len(ids)), self.n)[order]
        self.list_first = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=size))])
        self.list_most = np.zeros(size, np.int64)
        np.maximum.at(self.list_most, term, impact)
        full = np.flatnonzero(self.n)
        self.pivots = full[np.linspace(0, len(full) - 1, min(PIVOTS, len(full))).astype(np.int64)] if len(full) else full
        coordinates = np.zeros((size, len(self.pivots)), np.float32)
        for j, d in enumerate(self.pivots.tolist()):
            own = slice(first[d], first[d + 1])
            coordinates[term[own], j] = impact[own] / math.sqrt((impact[own].astype(float) ** 2).sum() + 1)
        self.near = np.zeros((len(ids), len(self.pivots)), np.float32)
        for i in range(0, len(full), 1024):
            own = full[i:i + 1024]
            at = ranges(self.first[own], self.n[own])
            self.near[own] = np.add.reduceat(coordinates[term[at]] * impact[at, None].astype(np.float32), np.cumsum(self.n[own]) - self.n[own], axis=0)

    def blocks(self, t: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents of a posting list, the block of each and the number of blocks: the nearest of the list's own pivots."""
        docs = self.list_docs[self.list_first[t]:self.list_first[t + 1]]
        if len(docs) <= BLOCK:
            return docs, np.zeros(len(docs), np.int64), 1
        own = np.flatnonzero(np.isin(self.pivots, docs))
        own = (own if len(own) > 1 else np.arange(len(self.pivots)))[:-(-len(docs) // BLOCK)]
        used, block = np.unique(self.near[np.ix_(docs, own)].argmax(axis=1), return_inverse=True)
        return docs, block, len(used)

    def summaries(self, docs: np.ndarray, block: np.ndarray, blocks: int, place: np.ndarray, width: int) -> np.ndarray:
        """Greatest impact of each coordinate in each block (blocks x ``width``); ``place`` has a term's coordinate, or -1."""
        at = ranges(self.first[docs], self.n[docs])
        to = place[self.term[at]]
        used = to >= 0
        out = np.zeros((blocks, width), np.int64)
        np.maximum.at(out, (np.repeat(block, self.n[docs])[used], to[used]), self.impact[at][used])
        return out

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Exact scores; ``weight`` has the query's repeats by term."""
        at = ranges(self.first[docs], self.n[docs])
        return np.add.reduceat(weight[self.term[at]] * self.impact[at], np.cumsum(self.n[docs]) - self.n[docs])


class Best:
    """The best documents of each query so far, and the score that a document needs to be among them."""

    def __init__(self, queries: Queries, needed: np.ndarray, top: int):
        self.queries, self.needed, self.top, self.rows = queries, needed.copy(), top, [[] for _ in queries.ids]

    def add(self, q: int, scores: np.ndarray, ids: list) -> None:
        rows = self.rows[q] + list(zip(scores.tolist(), ids))
        rows.sort(key=lambda r: (-r[0], r[1] is None, r[1]))
        self.rows[q] = rows[:self.top]
        if len(rows) >= self.top:
            self.needed[q] = max(self.needed[q], rows[self.top - 1][0])

    def visit(self, chunk: Chunk, size: int) -> None:
        for i in range(0, len(self.queries.ids), QUERIES):
            self._visit(chunk, size, range(i, min(i + QUERIES, len(self.queries.ids))))

    def _visit(self, chunk: Chunk, size: int, which: range) -> None:
        terms_of, repeats, lists = self.queries.terms, self.queries.repeats, {}
        for q in which:
            most = repeats[q] * chunk.list_most[terms_of[q]]
            order = np.argsort(most, kind="stable")
            for t in terms_of[q][order[(np.cumsum(most[order]) >= self.needed[q]) & (most[order] > 0)]].tolist():
                lists.setdefault(t, []).append(q)
        found = {q: [] for q in which}
        place = np.full(size, -1, np.int64)
        for t, users in lists.items():
            docs, block, blocks = chunk.blocks(t)
            coordinates = np.unique(np.concatenate([terms_of[q] for q in users]))
            place[coordinates] = np.arange(len(coordinates))
            summary = chunk.summaries(docs, block, blocks, place, len(coordinates))
            for q in users:
                passes = summary[:, place[terms_of[q]]] @ repeats[q] >= self.needed[q]
                if passes.any():
                    found[q].append(docs[passes[block]])
            place[coordinates] = -1
        weight = np.zeros(size, np.int64)
        for q, parts in found.items():
            if parts:
                docs = np.unique(np.concatenate(parts))
                weight[terms_of[q]] = repeats[q]
                scores = chunk.scores(docs, weight)
                weight[terms_of[q]] = 0
                good = scores >= max(1, self.needed[q])
                if good.sum() > self.top:  # ties with the k-th stay
                    good &= scores >= np.partition(scores[good], -self.top)[-self.top]
                self.add(q, scores[good], [chunk.ids[d] for d in docs[good].tolist()])


def best_documents(forward: DataFrame, queries: Broadcast, n: int, length: int, weight: np.ndarray, needed: np.ndarray, top: int,
                   item_type: DataType) -> DataFrame:
    """``query, item_id, doc_id, score``: each task's best documents of every query, found chunk by chunk."""
    size, doc_type = len(weight), forward.schema["doc_id"].dataType
    kinds = (pa.int64(), to_arrow_type(item_type), to_arrow_type(doc_type), pa.int64())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, postings = Best(queries.value, needed, top), [], 0

        def visit() -> None:
            ids, lengths, own, tf = zip(*held)
            m = np.array([25 + 75 * k * n // length for k in lengths], np.int64)
            count = np.array([len(x) // 4 for x in own], np.int64)
            term, times = (np.frombuffer(b"".join(x), "<i4").astype(np.int64) for x in (own, tf))
            impact = weight[term] * ((10 ** 9 * times) // (1000 * times + 8 * np.repeat(m, count)))
            best.visit(Chunk(list(ids), np.concatenate([[0], np.cumsum(count)]), term, impact, size), size)
            held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if not row[2]:
                    continue
                held.append(row)
                postings += len(row[2]) // 4
                if len(held) >= CHUNK_DOCS or postings >= CHUNK_POSTINGS:
                    visit()
                    postings = 0
        if held:
            visit()
        rows = [(best.queries.first + q, best.queries.ids[q], d, s) for q, found in enumerate(best.rows) for s, d in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, kinds)],
                                         names=["query", "item_id", "doc_id", "score"])

    return forward.mapInArrow(search, f"query long, item_id {item_type.simpleString()}, doc_id {doc_type.simpleString()}, score long")


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each query; ties by ascending id, null ids last."""
    order = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def blocks_of(items: DataFrame, item_id: str, text: str, size: int) -> Iterator[Queries]:
    """Queries in blocks of about ``size`` characters, fetched part by part."""
    rows, chars, first = [], 0, 0
    for r in items.select(F.col(item_id).alias("k"), F.col(text).alias("t")).toLocalIterator():
        rows.append((r["k"], r["t"]))
        chars += len(r["t"] or "")
        if chars >= size:
            yield Queries(rows, first)
            rows, chars, first = [], 0, first + len(rows)
    if rows:
        yield Queries(rows, first)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
           query_chars: int = QUERY_CHARS) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``top`` documents with a score above 0 for every row of ``items``, exact.

    Queries go in blocks of about ``query_chars`` characters, each against all documents: one pass over the texts makes the forward index,
    a hash sample of about ``SAMPLE`` documents is searched first for thresholds (any documents' scores give valid ones), then all are.

    A null or empty text has no term: such a document is never found, such an item has no row. Ids may be of any type; a null id counts as
    the last in ties; repeated rows of either table count each. Empty tables give no rows; texts are taken whole; further columns are left out."""
    spark, parts = docs.sparkSession, []
    kind = items.schema[item_id].dataType
    for queries in blocks_of(items, item_id, item_text, query_chars):
        size = len(queries.vocabulary)
        if not size:
            continue
        shared = spark.sparkContext.broadcast(queries)
        forward = stored(forward_index(docs, shared, doc_id, text), "search-forward")
        n, length, weight = weights(forward, size)
        if not n:
            continue
        none = np.zeros(len(queries.ids), np.int64)
        picked = F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE / n) * (1 << 30)))
        tried = ranked(best_documents(forward.where(picked).repartition(1), shared, n, length, weight, none, top, kind), top)  # about SAMPLE rows
        needed = none.copy()
        for r in tried.where(F.col("rank") == top).select("query", "score").collect():  # one row per query of the block
            needed[r["query"] - queries.first] = r["score"]
        parts.append(stored(ranked(best_documents(forward, shared, n, length, weight, needed, top, kind), top).select("item_id", "rank", "doc_id", "score"), "search-found"))
        dropped(forward)
    if not parts:
        return docs.sparkSession.createDataFrame([], StructType([StructField("item_id", kind), StructField("rank", IntegerType()),
                                                                 StructField("doc_id", docs.schema[doc_id].dataType), StructField("score", LongType())]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
