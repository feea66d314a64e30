"""Word break of mailbox names against plain loops."""
import random

from dossierflow.functions import mailboxes as mb


def plain_segments(part, own, vocabulary):
    for kind, phrases in mb.PHRASES.items():
        if part in phrases:
            return mb.KIND_BITS[kind]
    n, states = len(part), {0: 0}
    if n > mb.LOCAL_MAX:
        return -1
    for j in range(1, n + 1):
        for i in range(j):
            w = part[i:j]
            if i not in states:
                continue
            if w.isdigit() and (j == n or not part[j].isdigit()):
                states[j] = states[i]
            elif len(w) >= 3 and w in own:
                states[j] = states[i]
            elif w in vocabulary and (len(w) != 2 or w in mb.IN_COMPOUND or (i == 0 and j == n)):
                states[j] = states[i] | mb.KIND_BITS[vocabulary[w]]
            else:
                continue
            break
    return states.get(n, -1)


def test_segments_meet_plain_loops(spark):
    rng = random.Random(3)
    words = [*mb.VOCABULARY, "acme", "x", "24", "7", "maria", "hr", "joinus"]
    vocabulary = {w: k for w, k in mb.VOCABULARY.items() if rng.random() < 0.8}
    rows = [("".join(rng.choices(words, k=rng.randint(0, 4))), ["acme", "de"]) for _ in range(600)] + [("hr" * 40, []), ("a", []), ("", [])]
    df = spark.createDataFrame(rows, "part string, own array<string>")
    got = df.select(mb.segmented(df["part"], df["own"], vocabulary).alias("k")).collect()
    assert [r["k"] for r in got] == [plain_segments(p, o, vocabulary) if p else 0 for p, o in rows]


def test_kinds(spark):
    cases = {"jobs.dubai@acme.com": "apply", "sales24@acme.com": "never", "jordan.sales@acme.com": "general", "hrdubai@acme.com": "apply", "maria@acme.com": "general",
             "acmejobs@acme.com": "apply", "hr.press@x.de": "general", "dubai.sales@x.de": "general", "ta@x.de": "apply", "taxi@x.de": "general", "joinus@x.de": "apply",
             "people-and-culture@x.de": "apply", "info@x.de": "general", "itsupport@x.de": "never", "@x.de": "general"}
    df = spark.createDataFrame(list(cases.items()), "a string, k string")
    got = {r["a"]: r["got"] for r in df.select("a", mb.mailbox_kind("a").alias("got")).collect()}
    assert got == cases
