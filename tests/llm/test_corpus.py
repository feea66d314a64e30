"""Operators 1, 4 and 7 and the pipeline against plain loops."""
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from dossierflow.llm import decontamination, line_dedup, simhash
from tests.llm.rows import TEXTS, by_id
from tests.llm.test_token_files import check_packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["op1_benchmark_leaks", "op4_line_dedup"])
def test_query_and_sql(spark, con, name):
    got = entry.queries()[name](spark, SF)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert by_id(map(tuple, got.select(*names).collect())) == by_id(cursor.fetchall())


# --- operator 1

def grams(text, size=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def leaks(docs, items, least=0.8):
    out = set()
    for i, t in docs:
        for j, u in items:
            own, size = grams(u), min(5, len(re.findall(r"[^\W_]+", u or "")))
            if own and len(own & (grams(t) | grams(t, size))) >= least * len(own) - 1e-9:
                out.add((i, j))
    return out


def test_leaks_of_random_texts(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for k in range(40)]
    docs = []
    for i in range(150):
        own = rng.choices(words, k=rng.randint(0, 60))
        piece = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 2)):
            piece[rng.randrange(len(piece))] = "Changed"
        docs.append((i, " ".join(own[:20] + piece + own[20:])))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    expected = leaks(docs, items)
    assert len(expected) > 30
    for block in (1_000_000, 100):
        assert {(r.doc_id, r.item_id) for r in decontamination.contamination(d, b, block_shingles=block).collect()} == expected


def test_short_items_are_found_inside_long_documents(spark):
    items = [(1, "capital of France"), (2, "Paris"), (3, "one, two"), (4, "a b c d"), (5, "the capital of France is")]
    docs = [(1, "What is the Capital of France?"), (2, "of France capital"), (3, "paris " + "word " * 50), (4, "one two"), (5, "two one"), (6, "x a b c d y"), (7, "one")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contamination(d, b).collect()}
    assert got == leaks(docs, items) == {(1, 1), (3, 2), (4, 3), (6, 4)}


def test_leaks_of_odd_rows(spark, odd_docs, no_docs):
    items = [(1, None), (2, ""), (None, "three four five six seven eight NINE, ten"), (3, "a line another"), (4, "sit amet lorem ipsum dolor sit amet"),
             (4, "sit amet lorem ipsum dolor sit amet")]
    b = spark.createDataFrame([(*i, "k", 1.0) for i in items], "item_id long, text string, w string, n double")
    got = decontamination.contamination(odd_docs, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == leaks(TEXTS, items) and len(got) == len(leaks(TEXTS, items))
    assert decontamination.contamination(no_docs, b).collect() == [] == decontamination.contamination(odd_docs, b.where("false")).collect()
    dirty = {row for row in TEXTS if leaks([row], items)}
    clean = decontamination.decontaminated(odd_docs, b)
    assert clean.columns == odd_docs.columns
    assert by_id((r.doc_id, r.text) for r in clean.collect()) == by_id(row for row in TEXTS if row not in dirty)


def test_clean_texts_that_share_an_id_with_a_leak_stay(spark):
    leak, clean = "one two three four five six seven", "nothing of the items is in here at all"
    rows = [(None, leak), (None, clean), (None, None), (7, f"before {leak} after"), (7, clean), (7, clean), (8, leak), (9, clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, leak)], "item_id long, text string")
    left = decontamination.decontaminated(docs, items).collect()
    assert by_id((r.doc_id, r.text) for r in left) == by_id([(None, clean), (None, None), (7, clean), (7, clean), (9, clean)])


# --- operator 4

def deduped(rows):
    """Text and removed lines by (id, text); rows equal in both are one document, in the order of the operator for different ids."""
    gap, seen, out = " \t\n\x0b\f\r", set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        if t is None:
            out[i, t] = (None, [])
            continue
        lines = t.split("\n")
        counting = [k for k, x in enumerate(lines) if x.strip(gap)]
        gone = set()
        for k in range(len(counting) - 2):
            window = tuple(lines[p].strip(gap) for p in counting[k:k + 3])
            if window in seen:
                gone |= set(counting[k:k + 3])
            seen.add(window)
        out[i, t] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), sorted(gone))
    return out


def test_lines_of_random_texts(spark):
    rng = random.Random(2)
    docs = [(i, "\n".join(rng.choice(["a", "b", " c", "c ", "", "d\t", "e f"]) for _ in range(rng.randint(0, 12)))) for i in range(200)]
    got = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert by_id((r.doc_id, r.text, tuple(sorted(r.removed_lines))) for r in got) == by_id((i, t, tuple(g)) for (i, _), (t, g) in deduped(docs).items())


def test_lines_of_odd_rows(odd_docs, no_docs):
    got = line_dedup.line_dedup(odd_docs.withColumn("digest", F.lit(1)))
    expected = deduped([r for r in TEXTS])
    assert by_id((r.doc_id, r.text) for r in got.collect()) == by_id((i, expected[i, t][0]) for i, t in TEXTS)
    assert got.columns == [*odd_docs.columns, "digest", "n_lines", "removed_lines"]
    assert {r.n_lines for r in got.where("text is null").collect()} == {0}
    assert line_dedup.line_dedup(no_docs).collect() == []


# --- operator 7

def plain_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Of (id, fingerprint) rows: by fingerprint the smallest id that links reach."""
    own = sorted({f for _, f in prints})
    root = {f: f for f in own}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for k, a in enumerate(own):
        for b in own[k + 1:]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for i, f in prints:
        ids[find(f)] += [i] if i is not None else []
    return {f: min(ids[find(f)], default=None) for f in own}


def near(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    found = plain_components(prints)
    return by_id((i, f"{f:016x}", found[f]) for i, f in prints)


def test_near_duplicates(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert by_id(map(tuple, entry.queries()["op7_simhash"](spark, SF).collect())) == near(rows)


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    cols = ["doc_id", "fingerprint", "component_id"]
    assert by_id(map(tuple, simhash.near_duplicates(odd_docs).select(cols).collect())) == near(TEXTS)
    assert simhash.near_duplicates(no_docs).collect() == []
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(c) for _, _, c in near(TEXTS)})


def test_links_of_any_fingerprints(spark, monkeypatch):
    rng = random.Random(8)
    prints = {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
    for base in list(prints)[:40]:
        for _ in range(20):
            flipped = base
            for _ in range(rng.randint(1, 4)):
                flipped ^= 1 << rng.randrange(64)
            prints.add(flipped)
    prints |= {b for k in range(64) if (b := 1 << k)}  # a large group: all within two bits of each other
    signed = [(f - (1 << 64) if f >= 1 << 63 else f,) for f in prints]
    for small in (8, 2):
        monkeypatch.setattr(simhash, "SMALL_GROUP", small)
        edges = simhash.links(spark.createDataFrame(signed, "fp long"))
        roots = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(edges).collect()}
        expected, got = plain_components([(f, f) for f in prints]), defaultdict(set)
        for f in prints:
            got[roots.get(f, f)].add(f)
        want = defaultdict(set)
        for f, c in expected.items():
            want[c].add(f)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_long_chains_become_one_component(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, n + 1)} | {(1001, 1000)}


def test_fingerprints_of_long_texts():
    text = " ".join(random.Random(3).choices("abcdefgh", k=70_000))
    assert simhash.fingerprint(text.encode()) % (1 << 64) == plain_fingerprint(text)


# --- the pipeline

def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages, at = dict(corpus_pipeline.STAGES), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        at[name] = {r.doc_id: r for r in docs.collect()}
    verdict = {r.doc_id: r.kept for r in entry.queries()["op5_quality"](spark, SF).collect()}
    assert set(at["quality_rules"]) == {i for i, kept in verdict.items() if kept}
    rows = [(i, r.text) for i, r in at["quality_rules"].items()]
    assert {i: r.text for i, r in at["line_dedup"].items()} == {i: t for (i, _), (t, _) in deduped(rows).items()}
    assert all(r.n_chars == len(r.text) for r in at["line_dedup"].values())
    rows = [(i, r.text) for i, r in at["line_dedup"].items()]
    assert set(at["simhash_near_dedup"]) == {c for _, _, c in near(rows)}
    rows = [(i, r.text) for i, r in at["simhash_near_dedup"].items()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {i for i, _ in leaks(rows, items)}
    assert set(at["benchmark_decontamination"]) == {i for i, _ in rows} - dirty
    rows = [(i, r.text) for i, r in at["benchmark_decontamination"].items()]
    used, bound = check_packing(corpus_pipeline.run(spark, SF).collect(), rows, 2048)
    assert used <= 1.02 * bound + 1 and list(stages)[-1] == "best_fit_packing"
