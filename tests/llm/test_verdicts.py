"""Operators 5, 6 and 10: counts against plain loops, estimates against numpy, inference and prediction on known cases."""
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__ as entry
from dossierflow.llm import language_id, quality, secrets_scan
from tests.llm.rows import TEXTS, by_id

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


# --- operator 5

def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows, covered = {}, set()
    for k in range(len(words) - 7):
        windows.setdefault(tuple(words[k:k + 8]), []).append(k)
    for places in windows.values():
        if len(places) > 1:
            covered |= {p + j for p in places for j in range(8)}
    lines, again = set(), 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            again += x in lines
            lines.add(x)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), n < 20 or 100 * len(covered) > 30 * n


def base(rows):
    return by_id((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)


def test_counts(spark, given):
    got = entry.queries()["op5_quality"](spark, SF).collect()
    assert base(got) == by_id((r.doc_id, *counts(r.text)) for r in given)
    assert all(not r.kept for r in got if r.base_failed)


def test_counts_of_odd_and_random_rows(spark, odd_docs, no_docs):
    assert base(quality.quality(odd_docs).collect()) == by_id((i, *counts(t)) for i, t in TEXTS)
    assert quality.quality(no_docs).collect() == []
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "b ", " ", "\n", "é\x1c ", "# ", "\x0b"]) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS lang", "null AS source")
    assert base(quality.quality(docs).collect()) == by_id((i, *counts(t)) for i, t in enumerate(texts))


def test_junk_goes_and_clean_text_stays(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(400)]
    rows = []
    for i in range(900):
        own = [w.capitalize() if rng.random() < 0.1 else w for w in rng.choices(words, k=int(rng.lognormvariate(4.5, 0.6)) + 25)]
        junk = i % 10 == 0
        if junk:
            own = [w.upper() + "!!" for w in own] if i % 20 else [w + "###" for w in own]
        rows.append((i, " ".join(own), "en" if i % 3 else "de", f"s{i % 2}", junk))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, junk boolean")
    verdict = {r.doc_id: r.kept for r in quality.quality(docs, lent_rows=100).collect()}
    assert all(verdict[i] != junk for i, *_, junk in rows)
    kept = quality.kept_documents(docs, lent_rows=100)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, *_, junk in rows if not junk}


def test_small_groups_borrow_the_estimates_of_large_ones(spark):
    rng = random.Random(10)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(400)]
    rows = []
    for i in range(700):
        lang, source = ("en", "large") if i < 600 else ("en", "small") if i < 650 else (None, "rare")
        junk = i >= 600 and i % 5 == 0
        own = rng.choices(words, k=int(rng.lognormvariate(4.5, 0.4)) + 25)
        rows.append((i, " ".join(w.upper() + "!!" if junk else w for w in own), lang, source, junk))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, junk boolean")
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert len(got) == len(rows) and all(r.distance is not None for r in got.values())
    assert [i for i, *_, junk in rows if got[i].kept == junk] == []


@pytest.mark.parametrize("n", [0, 1, 5, 50, 5000])
def test_scatter_goes_over_from_the_language_to_the_group(spark, n):
    """Mean and covariance by plain matrices, whatever the rows of the group."""
    rng = np.random.default_rng(n)
    size, low = quality.P, np.tril_indices(quality.P)
    known, plain = [], {}
    for g, rows in (("g2", 900), ("g1", 300), ("g", n)):
        a = rng.normal(size=(size, size)) * 40
        cov, mean = a @ a.T + np.eye(size) * 100, rng.normal(size=size) * 100
        plain[g] = (rows, mean, cov * 1.5)
        if rows:
            known.append((("g", "g1", "g2").index(g), rows, mean.tolist(), np.linalg.inv(np.linalg.cholesky(cov))[low].tolist(), 1.5))
    k = spark.createDataFrame(known, "g long, n long, m array<double>, w array<double>, scale double")
    got = quality.shrunk(spark.createDataFrame([(0, 1, 2)], "g long, g1 long, g2 long"), k, 200).first()
    mean, cov = plain["g2"][1].copy(), np.diag([(quality.WIDE * quality.UNIT * s) ** 2 for s in quality.FEATURES.values()])
    for g, lent in (("g2", quality.GUESS_ROWS), ("g1", 200), ("g", 200)):
        rows, m, c = plain[g]
        cov = (rows * c + lent * cov) / (rows + lent) + rows * lent / (rows + lent) ** 2 * np.outer(m - mean, m - mean)
        mean = (rows * m + lent * mean) / (rows + lent)
    w = np.zeros((size, size))
    w[low] = got["w"]
    assert np.allclose(got["m"], mean) and np.allclose(np.linalg.inv(w) @ np.linalg.inv(w).T, cov)


def test_small_tables_have_verdicts(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(400)]
    rows = [(i, " ".join("###" + w.upper() + "!!" if i == 7 else w for w in rng.choices(words, k=60)), "en", f"s{i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.selectExpr("*", "1 AS _id", "2 AS _digest", "3 AS digest", "4 AS own", "5 AS g", "6 AS text_hash")
    assert {r.doc_id for r in quality.quality(docs).collect() if not r.kept} == {7}
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == 29


def test_estimates_meet_plain_concentration_steps(spark):
    rng = np.random.default_rng(1)
    x = np.rint(rng.normal(0, 300, (500, quality.P)) + rng.normal(0, 200, (500, 1))).astype(int)
    x[:60] += 4000
    rows = spark.createDataFrame([(1, *map(int, r)) for r in x], "g long, " + ", ".join(f"x{i} long" for i in range(quality.P)))
    got = quality.estimates(rows).first()
    floor = np.diag([(quality.UNIT * s) ** 2 for s in quality.FEATURES.values()])
    bins = lambda d: np.floor(64 * np.log2(1 + np.minimum(d, 1e12)))
    mid = np.median(x, axis=0)
    spread = (1.4826 * np.median(np.abs(x - mid), axis=0)) ** 2 + np.diag(floor)
    d, det = ((x - mid) ** 2 / spread).sum(axis=1), 0.0
    for _ in range(quality.STEPS):
        b = bins(d)
        own = x[b <= np.sort(b)[math.ceil(quality.KEPT_PART * len(x)) - 1]]
        mean, cov = own.mean(axis=0), np.cov(own.T, bias=True) + floor
        d, before, det = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean), det, np.linalg.slogdet(cov)[1]
        if abs(before - det) < 1e-9:
            break
    assert np.allclose(got.m, mean) and abs(got.det - det) < 1e-6
    assert d[:60].min() / got.scale > quality.chi_square(quality.P, 1 - quality.REJECTED) > np.sort(d[60:])[-5] / got.scale


def test_chi_square():
    for p, q, x in ((7, 0.5, 6.3458), (7, 0.999, 24.3219), (3, 0.95, 7.8147)):
        assert abs(quality.chi_square(p, q) / x - 1) < 0.01


# --- operator 6

def plain_spans(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def expected_base(rows):
    out = []
    for i, t in rows:
        own = plain_spans(t)
        told = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in own)
        out.append((i, *(sum(k == kind for _, k, _ in own) for kind in range(3)), hashlib.sha256(told.encode()).hexdigest()))
    return by_id(out)


def base_part(rows):
    for r in rows:
        own = [s for s in r.spans.split(",") if s and not s.startswith("format")]
        assert hashlib.sha256(",".join(own).encode()).hexdigest() == r.base_sha256
    return by_id((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows)


def test_base_spans(spark, given, odd_docs, no_docs):
    assert base_part(entry.queries()["op6_secrets"](spark, SF).collect()) == expected_base((r.doc_id, r.text) for r in given)
    assert base_part(secrets_scan.secret_spans(odd_docs).collect()) == expected_base(TEXTS)
    assert secrets_scan.secret_spans(no_docs).collect() == []


def test_base_spans_of_random_texts(spark):
    rng = random.Random(6)
    parts = ["token", "Password", "ſecret", "api_key", "apiKey", "toKen", "=", ": ", " ", '"', "'", "abcdef012345", "AKIA", "ABCDEFGH12345678", "x", "é", "-", "\n", "passwd", "0123456789abcdef"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 16)))) for i in range(2000)]
    got = secrets_scan.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert base_part(got) == expected_base(rows)


def test_automata_merge_states_and_keep_the_language():
    rng = random.Random(7)
    values = ["AKIA" + "".join(rng.choices("ABCDEFGHIJ0123456789", k=16)) for _ in range(400)]
    machine = secrets_scan.Automaton(values)
    assert machine.size < 60
    assert all(machine.score(secrets_scan.symbols(v)) > -math.inf for v in values)
    total = sum(2 ** (machine.score(f) * (len(f) + 1)) for f in {secrets_scan.symbols(v) for v in values})
    assert total <= 1 + 1e-9
    for foreign in ("hello-world-2024", "192.168.100.200", "http://a.b/c1"):
        assert machine.score(secrets_scan.symbols(foreign)) == -math.inf


def test_formats_without_a_keyword_are_found(spark):
    rng = random.Random(12)
    key = lambda: "sk_" + "".join(rng.choices("ghjkmnpqrstvwxyz23456789", k=20))
    rows = [(i, f'some text token = "{key()}" and more') for i in range(200)]
    bare = key()
    rows += [(900, f"left {bare} right"), (901, "see www.example.com/page-12/about for 2024-01-02T03:04 details"), (902, "mail user.name12@mail7.example.com now")]
    got = {r.doc_id: r.spans for r in secrets_scan.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[900] == f"format:5:{5 + len(bare)}"
    assert got[901] == got[902] == ""


def test_parts_of_runs_are_scored(spark):
    rng = random.Random(13)
    key = lambda letters="ghjkmnpqrstvwxyz23456789": "".join(rng.choices(letters, k=20))
    rows = [(i, f'some text token = "{key()}" and more') for i in range(300)]
    a, b, c, d, e = (key() for _ in range(5))
    f = key("ghjkmnpqrstvwxyz")
    rows += [(900, f"auth={a}"), (901, f"https://h.example/v1/{b}/x"), (902, f"it is {c}."), (903, f"now {f} here"), (904, f"x={d}/{e}."), (905, "www.example.com/page-12/a=b"),
             (906, f"0123456789abcdef/{a} and 5555-1234567890123"), (907, "=./" * 20000)]
    text = dict(rows)
    got = {r.doc_id: r.spans for r in secrets_scan.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = lambda i, *keys: ",".join(f"format:{text[i].index(k)}:{text[i].index(k) + 20}" for k in keys)
    assert {i: got[i] for i in range(900, 908)} == {900: at(900, a), 901: at(901, b), 902: at(902, c), 903: at(903, f), 904: at(904, d, e), 905: "",
                                                    906: "hex:0:16," + at(906, a), 907: ""}


def test_parts_meet_all_parts_of_a_run():
    rng = random.Random(14)
    machine = secrets_scan.Automaton(["".join(rng.choices("0123456789abcdgh/.", k=rng.randint(12, 18))) for _ in range(300)])
    least, hits = -3.9, 0
    for _ in range(300):
        form = secrets_scan.symbols("".join(rng.choices("12abgh/=.Q", weights=(3, 3, 3, 3, 2, 2, 2, 1, 1, 0.2), k=rng.randint(12, 60))))
        starts = [i for i in range(len(form)) if not i or form[i - 1] in secrets_scan.PARTED]
        ends = [i for i in range(1, len(form) + 1) if i == len(form) or form[i] in secrets_scan.PARTED]
        own = {(i, j) for i in starts for j in ends if j - i >= 12 and any(s in "agAG" for s in form[i:j]) and machine.score(form[i:j]) >= least}
        got = set(machine.parts(form, least))
        assert got <= own and {j for _, j in got} == {j for _, j in own}
        hits += len(own)
    assert hits > 100


# --- operator 10

def test_sums_over_all_segmentations():
    by_byte, size, ids_of = language_id.vocabulary(PIECES).by_byte, language_id.vocabulary(PIECES).size, vocabulary_ids()
    piece = ids_of.get

    def segmentations(marked):
        if not marked:
            yield []
        for n in range(1, len(marked) + 1):
            ids = [piece(marked[:n])] if piece(marked[:n]) is not None else [by_byte[b] for b in marked[0].encode()] if n == 1 else None
            if ids is not None:
                for rest in segmentations(marked[n:]):
                    yield ids + rest

    table = np.random.default_rng(2).random((size, 2)) / size
    words = ["the", "thesis", "a", "鿿x", "überall", ""]
    got, uses = language_id.likelihoods(words, table, PIECES), np.zeros(size)
    for row, word in zip(got, words):
        cuts = list(segmentations("▁" + word))
        assert np.allclose(row, np.log(sum(table[ids].prod(axis=0) for ids in cuts)))
        total = sum(size ** -float(len(ids)) for ids in cuts)
        for ids in cuts:
            np.add.at(uses, ids, size ** -float(len(ids)) / total * 2)
    assert np.allclose(language_id.expected(language_id.Counter({w: 2 for w in words}), PIECES), uses)
    long = language_id.likelihoods(["鿿" * 500, "the" * 100], table, PIECES)
    assert np.isfinite(long).all() and (long < -1000).any()


def vocabulary_ids():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    return {model.id_to_piece(i): i for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}


def test_words_of_any_length_are_summed_whole():
    ids, by_byte = vocabulary_ids(), language_id.vocabulary(PIECES).by_byte
    table = np.random.default_rng(3).random((language_id.vocabulary(PIECES).size, 3)) ** 4 / 1000
    section = language_id.SECTION
    words = ["x" * n for n in (47, 48, 49, section - 2, section - 1, section, section + 1)] + ["theinthe" * 90, "é鿿ab" * 150, "information" * 200, "\U0001f600"]
    for word, got in zip(words, language_id.likelihoods(words, table, PIECES)):
        text = "▁" + word
        sums = np.full((len(text) + 1, 3), -np.inf)
        sums[0] = 0
        for end in range(1, len(text) + 1):
            for begin in range(max(0, end - 40), end):
                cut = [ids[text[begin:end]]] if text[begin:end] in ids else [by_byte[b] for b in text[begin:end].encode()] if end == begin + 1 else None
                if cut:
                    sums[end] = np.logaddexp(sums[end], sums[begin] + np.log(table[cut]).sum(axis=0))
        assert np.allclose(got, sums[-1], rtol=1e-12)


def test_languages(spark, given):
    got = {r.doc_id: r for r in entry.queries()["op10_language"](spark, SF).collect()}
    truth = {r.doc_id: r.lang for r in given}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items()) and set(got) == set(truth)
    held = [i for i, r in got.items() if r.held_out and truth[i]]
    assert len(held) > 30 and sum(got[i].lang_pred == truth[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_languages_of_odd_rows(spark, odd_docs, no_docs):
    got = language_id.languages(odd_docs, PIECES).collect()
    assert by_id((r.doc_id,) for r in got) == by_id((i,) for i, _ in TEXTS)
    assert all((r.lang_pred == "und") == (r.doc_id in (1, 2, 3)) for r in got if r.doc_id is not None)
    assert language_id.languages(no_docs, PIECES).collect() == []
    none = language_id.languages(odd_docs.selectExpr("doc_id", "text", "cast(null as string) lang"), PIECES).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}


def test_held_out_texts_are_not_learned_from(spark):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, "uno dos tres cuatro" if i in held else "one two three four", "es" if i in held else "en") for i in range(400)]
    names, _ = language_id.learned(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES)
    assert names == ["en"]
