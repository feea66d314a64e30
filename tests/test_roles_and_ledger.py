"""Role matching and the field ledger against plain loops."""
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from dossierflow.operators import ledger, roles


def plain_match(a, b):
    """Classes in rounds, as the operator states it. Rows: (owner, id, key, title, year)."""
    def fold(rows):
        out = defaultdict(list)
        for o, i, k, t, y in sorted(rows, key=lambda r: r[1]):
            out[(o, k, y, t)].append(i)
        return out

    ca, cb = fold(a), fold(b)

    def may(x, y):
        name = x[1] == y[1] or min(len(x[1]), len(y[1])) >= 4 and (x[1] in y[1] or y[1] in x[1])
        return x[0] == y[0] and name and (x[2] == y[2] if x[2] and y[2] else x[3] == y[3] != "")

    pairs = [(x, y) for x in ca for y in cb if may(x, y)]
    left, used_a, used_b, out = [(x, y) for x, y in pairs if x[3] == y[3] and x[3]], defaultdict(int), defaultdict(int), []
    first_a, first_b = {x: v[0] for x, v in ca.items()}, {y: v[0] for y, v in cb.items()}
    while left:
        want, by = {}, {}
        for x, y in left:
            want[x] = min(want.get(x, y), y, key=lambda c: (first_b[c], c[1]))
            by[y] = min(by.get(y, x), x, key=lambda c: (first_a[c], c[1]))
        for x, y in [(x, y) for x, y in left if want[x] == y and by[y] == x]:
            for _ in range(min(len(ca[x]) - used_a[x], len(cb[y]) - used_b[y])):
                out.append((ca[x][used_a[x]], cb[y][used_b[y]], "title"))
                used_a[x] += 1
                used_b[y] += 1
        left = [(x, y) for x, y in left if used_a[x] < len(ca[x]) and used_b[y] < len(cb[y])]
    taken_a, taken_b = {i for i, _, _ in out}, {j for _, j, _ in out}
    for x in sorted(ca, key=first_a.get):
        found = [j for p, y in pairs if p == x for j in cb[y]]
        for i in ca[x]:
            if i not in taken_a and len(found) == 1 and found[0] not in taken_b:
                out.append((i, found[0], "only"))
                taken_b.add(found[0])
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_roles_match_one_to_one(spark, seed):
    rng = random.Random(seed)
    names = ["Acme", "Acme Trading LLC", "Acme Trading Services", "abc", "abc Group", "Nord Trading", "Trading", "— x", None]

    def side(first):
        return [(rng.randint(1, 4), first + i, rng.choice(names), rng.choice(["Head", "head.", "Clerk", ""]), rng.choice([2001, 2002, None])) for i in range(60)]

    a, b = side(0), side(1000)
    schema = "owner long, {} long, employer string, title string, year int"
    got = roles.match_roles(spark.createDataFrame(a, schema.format("a_id")), spark.createDataFrame(b, schema.format("b_id")), "owner")
    legal = {"llc", "group", "services"} - {"services"}

    def plain(rows):
        out = []
        for o, i, e, t, y in rows:
            key = " ".join(w for w in (e or "").split(" — ")[0].lower().replace("—", " ").split() if w not in legal)
            if key:
                out.append((o, i, key, t.lower().rstrip("."), y))
        return out

    assert sorted(map(tuple, got.collect())) == plain_match(plain(a), plain(b))


def test_export_corrects_matched_roles(spark):
    cv = spark.createDataFrame([(1, "Sales Head", "Acme", "2019", ["own"]), (2, "Clerk", "Nord", "", ["b"])], "a_id long, title string, employer string, dates string, lines array<string>")
    export = spark.createDataFrame([(7, "Head of Sales", "Acme LLC", "Jan 2019")], "b_id long, title string, employer string, dates string")
    matches = spark.createDataFrame([(1, 7, "only")], "a_id long, b_id long, pass string")
    got = roles.corrected_roles(cv, export, matches, ["title", "employer", "dates"]).orderBy("a_id").collect()
    assert [tuple(r)[:4] + (r["lines"],) for r in got] == [(1, "Head of Sales", "Acme LLC", "Jan 2019", ["own"]), (2, "Clerk", "Nord", "", ["b"])]


# --- ledger

FIELDS = ledger.FIELDS


def apply(state, item):
    """One message on a record's state, in place; the writes it made."""
    before = dict(state)
    _, _, way, cls, day = item
    if way == "out":
        unsent = state["stage"] in ledger.UNSENT
        if day and (unsent or state["sent"] is None or day < state["sent"]):
            state["sent"] = day
        state["stage"] = ledger.step(state["stage"], "sent")
    else:
        if day and cls != "read" and (state["last_inbound"] is None or day > state["last_inbound"]):
            state["last_inbound"] = day
        if day and cls == "read" and (state["opened"] is None or day < state["opened"]):
            state["opened"] = day
        if state["stage"] == "prepared" and state["sent"] is None:
            state["sent"] = state["prepared"] or day
        state["stage"] = ledger.step(state["stage"], cls)
    return [(f, before[f], state[f]) for f in FIELDS if before[f] != state[f]]


def random_case(seed):
    rng = random.Random(seed)
    day = lambda: f"2024-01-{rng.randint(1, 28):02d}" if rng.random() > 0.1 else None
    records = {k: {"stage": rng.choice(ledger.STAGES), "sent": day() if rng.random() < 0.3 else None, "last_inbound": None, "opened": None,
                   "prepared": day()} for k in range(8)}
    items, n = [], defaultdict(int)
    for i in range(400):
        k = rng.choice([0, 0, 0, 0, 1, 2, 3, 4, 5, 6])
        items.append((k, i, rng.choice(["in", "in", "in", "out"]), rng.choice([*ledger.KINDS[1:], "odd"]), day()))
    return records, items


def frames(spark, records, items):
    r = spark.createDataFrame([(k, *(s[f] for f in ("stage", "sent", "last_inbound", "opened", "prepared"))) for k, s in records.items()],
                              "k long, stage string, sent string, last_inbound string, opened string, prepared string")
    for f in ("sent", "last_inbound", "opened", "prepared"):
        r = r.withColumn(f, F.col(f).cast("date"))
    n, rows = defaultdict(int), []
    for k, i, way, cls, day in items:
        rows.append((k, n[k], i, way, cls, day))
        n[k] += 1
    return spark.createDataFrame(rows, "k long, seq long, item long, dir string, cls string, day string").withColumn("day", F.col("day").cast("date")), r


@pytest.mark.parametrize("block", [3, 256])
def test_ledger_and_undo(spark, monkeypatch, block):
    monkeypatch.setattr(ledger, "BLOCK", block)
    records, items = random_case(block)
    i, r = frames(spark, records, items)
    state, wanted, seqs = {k: dict(s) for k, s in records.items()}, [], defaultdict(int)
    for item in items:
        wanted += [(item[0], seqs[item[0]], item[1], *w) for w in apply(state[item[0]], item)]
        seqs[item[0]] += 1
    got = [tuple(x) for x in ledger.field_ledger(i, r, "k").select("k", "seq", "item", "field", "was", "became").collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)

    taken = {x for x in range(400) if x % 3 == 0}
    rows = ledger.take_back(ledger.field_ledger(i, r, "k"), spark.createDataFrame([(x,) for x in taken], "item long"), "k").collect()
    left, chain = [], {}
    for k, seq, item, f, was, became in sorted(wanted, key=lambda w: (w[0], w[1])):
        start = chain.setdefault((k, f), was)
        if item not in taken:
            left.append((k, seq, item, f, start, became, start != was))
            chain[(k, f)] = became
    assert sorted(map(tuple, rows), key=str) == sorted(left, key=str)


def test_undo_confirm_and_ignore(spark):
    """An applied reply taken back, one set aside, and one given to another record."""
    records = {1: {"stage": "applied", "sent": "2024-01-01", "last_inbound": None, "opened": None, "prepared": None},
               2: {"stage": "prepared", "sent": None, "last_inbound": None, "opened": None, "prepared": "2024-01-02"}}
    items = [(1, 10, "in", "read", "2024-01-03"), (1, 11, "in", "ack", "2024-01-04"), (1, 12, "in", "interview", "2024-01-06"), (1, 13, "in", "read", "2024-01-02"),
             (1, 14, "in", "rejection", "2024-01-09")]
    i, r = frames(spark, records, items)
    decisions = spark.createDataFrame([(14, "undo", None, 1), (13, "ignore", None, 2), (12, "confirm", 2, 3), (11, "confirm", 99, 4), (10, "undo", None, 5), (10, "confirm", 1, 6)],
                                      "item long, action string, to long, at long")
    state, rows = ledger.decided(r, i, decisions, "k")
    got = {x["k"]: tuple(map(str, (x["stage"], x["sent"], x["last_inbound"], x["opened"]))) for x in state.collect()}
    assert got == {1: ("ack", "2024-01-01", "2024-01-04", "2024-01-03"), 2: ("interview", "2024-01-02", "2024-01-06", "None")}
    assert {(x["item"], x["field"]) for x in rows.collect()} == {(11, "stage"), (11, "last_inbound"), (12, "stage"), (12, "last_inbound"), (12, "sent"), (10, "opened")}
