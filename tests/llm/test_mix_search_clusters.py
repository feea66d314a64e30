"""Operators 11 to 13 against plain loops, on the given tables and on odd rows."""
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossierflow.llm import centroids, mixing, search
from tests.llm.rows import by_id

SF = "/root/testdata/sf0.001"


def plain_search(docs, items, top=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))
    counted = [(k, Counter(words(t))) for k, t in docs]
    counted = [(k, c) for k, c in counted if c]
    n, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        rows = []
        for k, c in counted:
            m = 25 + 75 * sum(c.values()) * n // length
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                    for t, q in Counter(words(text)).items() if c[t])
            if s > 0:
                rows.append((-s, k is None, k))
        out += [(item, i + 1, r[2], -r[0]) for i, r in enumerate(sorted(rows)[:top])]
    return out


ITEMS = [(1, "one two three"), (1, "one two three"), (2, None), (3, "A LINE another line line"), (None, "lorem x é twelve"), (4, "nothing-of-this")]


def test_search_of_odd_rows(spark, odd_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    found = search.search(odd_docs, items).collect()
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert by_id(map(tuple, found)) == by_id(plain_search(docs, ITEMS))
    assert {r["rank"] for r in found if r["item_id"] == 3} == {1, 2, 3}


def test_search_without_documents_or_items(spark, odd_docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.search(no_docs, items).count() == 0
    empty = search.search(odd_docs, items.where("false"))
    assert empty.count() == 0 and empty.columns == ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("chunk, sample, block", [(7, 20, 3), (64, 5, 4), (16_384, 4096, 32)])
def test_search_in_chunks_and_blocks(spark, monkeypatch, chunk, sample, block):
    monkeypatch.setattr(search, "CHUNK_DOCS", chunk)
    monkeypatch.setattr(search, "SAMPLE", sample)
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "QUERIES", 3)
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    found = search.search(docs, items, query_chars=3000).collect()
    wanted = plain_search([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert sorted(map(tuple, found)) == sorted(wanted)


def test_blocks_are_skipped_by_their_summaries():
    rng = np.random.default_rng(5)
    n, size = 400, 50
    own = [np.unique(rng.integers(0, 10, 6) + 10 * (d % 5)) for d in range(n)]
    first = np.concatenate([[0], np.cumsum([len(x) for x in own])])
    chunk = search.Chunk(list(range(n)), first, np.concatenate(own), rng.integers(1, 1000, first[-1]), size)
    docs, block, blocks = chunk.blocks(3)
    assert blocks > 1 and sorted(docs) == [d for d in range(n) if 3 in own[d]]
    summary = chunk.summaries(docs, block, blocks, np.arange(size), size)
    for b in range(blocks):
        for t in range(size):
            impacts = [chunk.impact[first[d]:first[d + 1]][own[d] == t] for d in docs[block == b]]
            assert summary[b, t] == max((int(i[0]) for i in impacts if len(i)), default=0)


def plain_targets(sizes):
    weights, total = [(5, 2, 1)[i % 3] for i in range(len(sizes))], sum(sizes)
    target = [total * w / sum(weights) for w in weights]
    full = set()
    while any(t > 3 * s + 1e-9 for t, s in zip(target, sizes)):
        full |= {i for i, (t, s) in enumerate(zip(target, sizes)) if t > 3 * s + 1e-9}
        left = total - sum(3 * sizes[i] for i in full)
        free = sum(w for i, w in enumerate(weights) if i not in full)
        target = [3 * sizes[i] if i in full else left * w / free for i, w in enumerate(weights)]
    return target


def mixed(docs, **options):
    pieces, streams, plan = mixing.mix(docs, **options)
    return pieces, mixing.taken_report(pieces, streams, plan).collect()


def check_mix(docs, report):
    wanted = Counter((r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in docs)
    assert Counter((r["doc_id"], r["size"]) for r in report) == wanted
    names = sorted({r["source"] for r in docs}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs if r["source"] == s) for s in names]
    target = dict(zip(names, plain_targets(sizes)))
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in report)
    by_target = Counter()
    for r in report:
        by_target[(r["source_size"], round(r["target"], 6))] += r["taken"]
    wanted = Counter()
    for s, n in zip(names, sizes):
        wanted[(n, round(target[s], 6))] += target[s]
    assert set(by_target) == set(wanted)
    for k, taken in by_target.items():
        assert abs(taken - wanted[k]) <= 0.5 * len(names)


@pytest.mark.parametrize("block, shard", [(2048, 1024), (100, 16), (7, 64)])
def test_mix_meets_its_targets(spark, block, shard):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces, report = mixed(docs, block=block, shard_slots=shard)
    check_mix(docs.collect(), report)
    again = mixed(docs.repartition(5), block=block, shard_slots=shard)[1]
    assert sorted(map(tuple, report)) == sorted(map(tuple, again))
    slots = pieces.groupBy("shard", "slot").agg(F.sum("length").alias("n"), F.max(F.col("at") + F.col("length")).alias("end"), F.countDistinct("source").alias("s"))
    assert slots.where(f"n > {block} or s > 1").count() == 0
    assert slots.where("n <> end").count() == 0
    shards = slots.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m")).orderBy("shard").collect()
    assert all(r["n"] == shard for r in shards[:-1]) and all(r["m"] == r["n"] - 1 for r in shards)


def test_mix_of_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.unionByName(odd_docs.withColumn("source", F.lit("a")).withColumn("size", F.lit(3))
                                .withColumn("key", F.lit("k")).select(*odd_docs.columns))
    pieces, report = mixed(docs, block=5, shard_slots=4)
    check_mix(docs.collect(), report)
    pieces, report = mixed(no_docs)
    assert report == [] and pieces.count() == 0


def test_mix_of_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 10)
    docs = spark.createDataFrame([(None, "a b c", "s")] * 57 + [(1, "x y", "t")] * 3, "doc_id long, text string, source string")
    check_mix(docs.collect(), mixed(docs, block=4, shard_slots=8)[1])


def test_draws_follow_the_shares(spark):
    plan = mixing.Plan(["a", "b", "c"], [600_000, 200_000, 200_000], 10, (5, 2, 1), 3, 12)
    rows = mixing.drawn_slots(spark, plan, 1000).groupBy("shard", "source_at").count().collect()
    assert len({r["count"] for r in rows if r["source_at"] == 0}) > 20
    for i, share in enumerate((5 / 8, 2 / 8, 1 / 8)):
        own = [r["count"] for r in rows if r["source_at"] == i]
        assert abs(np.mean(own) - 1000 * share) < 5 and 0.6 < np.std(own) / (1000 * share * (1 - share)) ** 0.5 < 1.4


def plain_clusters(rows, k=8, rounds=10, dimension=64):
    kept = [(i, [math.floor(1024 * v) for v in x]) for i, x in rows
            if x is not None and len(x) == dimension and all(v is not None and math.isfinite(v) for v in x)]
    if not kept:
        return []
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centres = [list(x) for _, x in seeds]
    for last in [False] * rounds + [True]:
        found = [min((far(x, c), j) for j, c in enumerate(centres)) for _, x in kept]
        if not last:
            for j in range(len(centres)):
                own = [x for (_, x), (_, f) in zip(kept, found) if f == j]
                if own:
                    centres[j] = [sum(c) // len(own) for c in zip(*own)]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    inertia = Counter()
    for d, j in found:
        inertia[j] += d
    return [(i, j, d, inertia[j], sum(inertia.values()), names[j]) for (i, _), (d, j) in zip(kept, found)]


def test_clusters_of_the_given_vectors(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    found = centroids.cluster_report(*centroids.clusters(vectors)).collect()
    assert sorted(map(tuple, found)) == sorted(plain_clusters([(r["vec_id"], r["embedding"]) for r in vectors.collect()]))


def test_clusters_of_odd_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(60)]
    rows += [(None, rows[3][1]), (None, [0.0] * 4), (5, rows[5][1]), (5, rows[5][1]), (70, [0.0, None, 1.0, 2.0]), (71, [0.0, float("nan"), 1.0, 2.0]),
             (72, [float("inf")] * 4), (73, None), (74, []), (75, [1.0] * 5), (76, [-0.0, -1e-9, 5e4, -5e4])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit(1)).withColumn("own", F.lit(2))
    for k in (3, 8, 200):
        found = centroids.cluster_report(*centroids.clusters(vectors, k=k, dimension=4)).collect()
        assert by_id(map(tuple, found)) == by_id(plain_clusters(rows, k=k, dimension=4))
    assert centroids.cluster_report(*centroids.clusters(vectors.where("false"))).count() == 0
    with pytest.raises(Exception, match="component beyond"):
        centroids.clusters(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"), dimension=1)


def test_bounds_save_distances(monkeypatch):
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(2000, 16)) * 40 + 1000 * rng.integers(0, 6, 2000)[:, None]).astype(np.int64)
    history, computed = x[:6][None], []
    known = np.stack([centroids.squared(x, c) for c in history[0]], axis=1)
    state = known.argmin(axis=1), known, np.zeros((2000, 6), np.int64)
    plain = centroids.squared
    monkeypatch.setattr(centroids, "squared", lambda a, c: computed.append(len(a)) or plain(a, c))
    for _ in range(8):
        now = history[-1].copy()
        for j in range(6):
            if (state[0] == j).any():
                now[j] = x[state[0] == j].sum(axis=0) // (state[0] == j).sum()
        history = np.concatenate([history, now[None]])
        state = centroids.assigned(x, *state, history)
        assert (state[0] == np.stack([plain(x, c) for c in now], axis=1).argmin(axis=1)).all()
    assert sum(computed) < 0.6 * 8 * x.shape[0] * 6
