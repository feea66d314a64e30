"""Steps that did more work than their input asks for: each test fails on the form before."""
import json
import random
import re

import pandas as pd

from dossierflow.operators import links as lk
from dossierflow.operators import merge as mg
from dossierflow.operators import roles
from dossierflow.queries import aggregates, lint
from dossierflow.streaming import tracker


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


class Given:
    """Three small tables in place of the given ones."""

    def __init__(self, spark):
        self.documents = spark.createDataFrame([(1, "alpha first\nbeta gamma\nalpha beta delta", "en", "a"), (2, "gamma " + "x " * 40 + "alpha", "en", "b"), (3, None, None, None)],
                                               "doc_id long, text string, lang string, source string")
        self.benchmark = spark.createDataFrame([(0, "alpha line\ngamma"), (1, "betas\ndelta")], "item_id long, text string")
        self.lexicon = spark.createDataFrame([("alpha",), ("beta",), ("gamma",), ("delta",)], "concept string")


def test_must_haves_are_found_once_and_only_their_words_are_moved(spark):
    t = Given(spark)
    assert "collect_list" in plan(aggregates.report_rows(t))
    assert sorted(map(tuple, lint.zone_tokens(t).collect())) == [(0, "alpha", True), (0, "alpha", True), (0, "beta", True), (0, "beta", True), (0, "delta", True), (0, "gamma", True),
                                                                 (1, "alpha", False), (1, "gamma", True)]


def plain_trace(lines, pool):
    stem = lambda w: re.sub(r"(?:ing|ed|es|s|en|n)$", "", w)
    out = []
    for doc, ix, line in lines:
        found = []
        if doc is not None and ix is not None:
            for j, n in {(j, len({stem(w) for w in x.split()})) for d, j, x in pool if d == doc and x is not None}:
                shared = sum(stem(w) in {stem(v) for v in x.split()} for d, i, y in lines if (d, i) == (doc, ix) and y is not None for w in y.split()
                             for e, k, x in pool if (e, k) == (doc, j) and x is not None and len({stem(v) for v in x.split()}) == n)
                if shared:
                    found.append((-shared, n, j))
        shared, _, best = min(found, default=(0, 0, None))
        for have in [x for d, j, x in pool if (d, j) == (doc, best)] if best is not None else [""]:
            own = None if line is None else [w for w in line.split()[1:] if w not in lk.TRACE_FREE]
            out.append((doc, ix, best, -shared, None if own is None else sum(stem(w) not in {stem(v) for v in (have or "").split()} for w in own)))
    return sorted(map(str, out))


def test_lines_are_traced_without_a_join(spark):
    rng = random.Random(7)
    words = ["selling", "sells", "sell", "the", "and", "houses", "house", "n", "open", "opens", "red"]
    text = lambda: " ".join(rng.choices(words, k=rng.randint(0, 6)))
    lines = [(rng.choice([1, 2, 3, None]), rng.choice([0, 1, None]), rng.choice([text(), text(), text(), None])) for _ in range(40)]
    pool = [(rng.choice([1, 2, 4, None]), rng.choice([0, 1, 2]), rng.choice([text(), text(), text(), None])) for _ in range(40)]
    got = lk.trace_source(spark.createDataFrame(lines, "d long, line_ix int, line string"), spark.createDataFrame(pool, "d long, pool_ix int, pool_line string"), "d")
    assert got.columns == ["d", "line_ix", "pool_ix", "shared", "n_added"] and [t for _, t in got.dtypes] == ["bigint", "int", "int", "int", "int"]
    assert "Join" not in plan(got)
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_trace(lines, pool)


def test_added_lines_are_told_once(spark):
    rng = random.Random(3)
    long = lambda k: " ".join(f"word{rng.randint(0, 9)}" for _ in range(k))
    own = [long(9) for _ in range(12)] + ["short", "", "Short!"]
    new = [long(9) for _ in range(4)] + [f"xx {own[0]} yy", own[1][3:50], own[2].upper(), "short", "new", "new", "", own[3][:20]]
    schema = "k int, h string, s string, sk array<string>, ls array<string>"
    got = mg.merge_profiles(spark.createDataFrame([(1, "", "", [], own), (2, "", "", [], [])], schema), spark.createDataFrame([(1, "", "", [], new), (2, "", "", [], new)], schema),
                            "k", ["h"], ["s"], "sk", "ls")
    norm = lambda x: " ".join(re.findall(r"[a-z0-9]+", x.lower()))
    same = lambda x, y: x == y or (len(x) >= 40 and len(y) >= 40 and (x in y or y in x))
    rows = {r["k"]: r for r in got.collect()}
    for k, base in ((1, own), (2, [])):
        fresh = [x for x in new if norm(x) and not any(same(norm(o), norm(x)) for o in base)]
        assert rows[k]["ls"] == base + fresh and rows[k]["gained_lines"] == len(fresh)
    assert 0 < rows[1]["gained_lines"] < rows[2]["gained_lines"]
    assert "array_contains(lambda" in plan(got.select("gained_lines"))


def test_names_of_roles_are_read_once(spark, monkeypatch):
    plans, saved = [], roles.saved
    monkeypatch.setattr(roles, "saved", lambda df, name: (plans.append(plan(df)), saved(df, name))[1])
    side = lambda ident, first: spark.createDataFrame([(1, first, "Acme LLC", "Head", 2001), (1, first + 1, "Nord", "Clerk", None)], f"owner long, {ident} long, employer string, title string, year int")
    got = roles.match_roles(side("a_id", 0), side("b_id", 10), "owner")
    assert sorted(map(tuple, got.collect())) == [(0, 10, "title"), (1, 11, "title")]
    assert sum("holding" in p for p in [*plans, plan(got)]) == 2


class Handle:
    """State of one record in memory; counts the calls."""

    def __init__(self):
        self.calls, self.timers, self.value, self.map = 0, [], None, {}

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def exists(self):
        self.calls += 1
        return self.value is not None

    def update(self, value):
        self.calls += 1
        self.value = value

    def containsKey(self, key):
        self.calls += 1
        return key in self.map

    def getValue(self, key):
        self.calls += 1
        return self.map.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.map[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.map[key]

    def iterator(self):
        self.calls += 1
        return iter(list(self.map.items()))

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


def test_a_trigger_reads_and_writes_blocks_of_keys():
    handle, job = Handle(), tracker.RecordTracker()
    job.init(handle)

    def trigger(first, n, day, decision="auto", way="in"):
        handle.calls = 0
        rows = pd.DataFrame({"message": [f"m{i}" for i in range(first, first + n)], "dir": way, "cls": "ack", "day": day, "decision": decision, "at": range(n)})
        return [tuple(r) for out in job.handleInputRows(("1",), iter([rows]), None) for r in out.itertuples(index=False)]

    assert trigger(0, 1000, "2024-01-01", "unmatched") == [] and handle.calls <= 40
    assert max(len(json.loads(v[0])) for v in handle.map.values()) <= 2 * tracker.BLOCK
    assert trigger(0, 900, "2024-01-01", "suggested") == [] and handle.calls <= 40
    assert trigger(0, 900, "2024-01-02", way="out") == []  # all read before
    assert trigger(900, 101, "2024-01-03", way="out") == [("1", "record", "applied", "2024-01-03", None, None)]
    assert len(handle.timers) == 1 and trigger(1000, 1, "2024-01-01", way="out") == []

    class At:
        def __init__(self, day):
            self.day = day

        def getExpiryTimeInMs(self):
            return tracker.milliseconds(self.day)

    handle.calls = 0
    assert len(list(job.handleExpiredTimer(("1",), None, At("2024-01-07")))) == 1 and handle.calls == 1  # nothing is old enough
    list(job.handleExpiredTimer(("1",), None, At("2024-06-30")))  # the horizon is the second of January
    assert sum(len(json.loads(v[0])) for v in handle.map.values()) == 101 and job.held()[2:] == (101, "2024-01-03")
    assert trigger(0, 1, "2024-01-02", way="out") != []  # forgotten, so read again


