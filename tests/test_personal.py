"""Uses of nationality words, and overlaps of typed spans."""
import random

import pytest

from dossierflow.operators import personal as ps


@pytest.mark.parametrize("text, uses", [
    ("Nationality: German", ["labelled"]), ("Fluent in German and French", ["language", "language"]), ("German, Austrian and Swiss operations", ["market"] * 3),
    ("I am Lebanese and live in Dubai", ["self"]), ("Jordanian national", ["self"]), ("German passport", ["work right"]), ("Visa: Indian", ["work right"]), ("Dubai\nEgyptian\n+971", ["self"]),
    ("German, Arabic, French", ["language", "language"]), ("worked with the German lead", ["unclear"]), ("German-speaking markets", ["language"]), ("a British-owned company", ["market"]),
    ("as an Italian I cook", ["self"]), ("Germanic texts", []), ("", [])])
def test_uses(text, uses):
    assert [u for *_, u in ps.nationality_uses(text)] == uses


def test_spans_are_typed_and_do_not_overlap(spark):
    text = "Nationality: Omani | Date of birth: 1 May 1980\nmarried, two children; age: 45; call +971 50 123 4567 or a.b@x.ae\nGerman markets, fluent French"
    rows = ps.personal_spans(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string"), ["id"], "t").collect()
    got = [(text[r["start"]:r["end"]], r["kind"], r["label"]) for r in rows]
    assert ("Nationality", "nationality", True) in got and ("Omani", "nationality", False) not in got[:1]
    assert {k for _, k, _ in got} >= {"nationality", "birth", "children", "age", "phone", "email"}
    assert not any(word in ("German", "French") for word, *_ in got)
    assert all(a["end"] <= b["start"] for a, b in zip(rows, rows[1:])) and {r["id"] for r in rows} == {1}


def test_sweep_meets_plain_loops():
    rng = random.Random(4)
    for _ in range(300):
        found = []
        for _ in range(rng.randint(0, 25)):
            start = rng.randint(0, 40)
            found.append((rng.random() < 0.5, rng.randint(0, 3), start, start + rng.randint(1, 9), "k", "c"))
        found = sorted(set(found), key=lambda c: (c[0], c[1], c[2] - c[3], c[2]))
        kept = []
        for c in found:
            if all(c[3] <= k[2] or k[3] <= c[2] for k in kept):
                kept.append(c)
        assert [s[:2] for s in ps.resolved(found)] == sorted((c[2], c[3]) for c in kept)
