"""Steps that do the same with less work: each test fails on the form before."""
from pyspark.sql import functions as F

from dossierflow.functions import profiles as pf
from dossierflow.functions import text as tx
from dossierflow.operators import filters as fl
from dossierflow.operators import lexicon as lx
from dossierflow.operators import links as lk
from dossierflow.operators import personal as ps
from dossierflow.operators.scale import worked_out_once
from dossierflow.plans import lint as li


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_language_gate_leaves_the_text_and_deals_languages_out(spark):
    df = spark.createDataFrame([(1, "straße", "de"), (2, "straße", "en"), (3, "street", None), (4, None, "en")], "doc_id int, text string, lang string")
    allowed = spark.createDataFrame([("de",)], "lang string")
    out = fl.language_gate(df, F.col("text").rlike("ß"), "lang", allowed)
    assert out.columns == ["lang", "doc_id", "text"]
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3]
    join = next(line for line in plan(out.select("doc_id")).splitlines() if "Join" in line)
    assert "_salt" in join and "text" not in join


def test_language_rows_cut_marked_parts_only(spark):
    df = spark.createDataFrame([("English (C1) · German: fluent, French",)], "l string").select(F.explode(pf.language_rows("l")).alias("r")).select("r.*")
    got = [(r["name"], r["code"], r["level"], r["cefr"], r["raw"]) for r in df.collect()]
    assert got == [("English", "en", None, "C1", "English (C1)"), ("German", "de", 4, "", "German: fluent"), ("French", "fr", None, "", "French")]
    assert "RLIKE" in plan(df).split("regexp_extract")[0]


def test_runs_of_unwanted_lengths_are_not_made(spark):
    w = F.split(F.lit("a b c"), " ")
    row = spark.range(1).select(lx.word_gram_keys(w, 3, lambda n: F.lit(n == 3)).alias("three"), lx.gram_keys(F.lit("a b c"), 3).alias("all")).first()
    assert len(row["three"]) == 1 and set(row["three"]) < set(row["all"])


def test_contained_lines_reads_each_side_once(spark):
    long, short = "one two three four five six seven eight nine ten", "two three four five six seven eight nine"
    word = "x" * 45
    a = spark.createDataFrame([(1, long), (2, short), (3, word), (4, "same"), (5, "")], "d int, t string")
    b = spark.createDataFrame([(1, short), (2, long), (3, f"a {word} b"), (4, "Same!"), (5, None)], "i int, u string")
    out = lk.contained_lines(a, ["d"], "t", b, ["i"], "u")
    assert sorted(map(tuple, out.collect())) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3), (4, 4)]
    assert plan(out).count("Join") == 1


def test_near_duplicates_of_a_document_in_two_rows(spark):
    words = "alpha bravo charlie delta foxtrot hotel"
    rows = [(1, 0, words), (1, 1, "short"), (1, 2, words.replace("hotel", "india") + " hotel"), (1, 3, words), (None, 0, words), (None, 1, words), (2, 0, words)]
    out = lk.near_duplicate_lines(spark.createDataFrame(rows, "d int, ix int, t string"), "d", "ix", "t")
    assert sorted(map(tuple, out.collect())) == [(1, 2, 0, "near"), (1, 3, 0, "exact")]
    assert "Join" not in plan(out)


def test_personal_rules_run_where_their_words_are():
    kinds = {k.name: k for k in ps.KINDS}
    assert not kinds["email"].may_be_in("no address here", False) and kinds["email"].may_be_in("a@b.de", False)
    assert not kinds["age"].may_be_in("aged", False) and kinds["age"].may_be_in("aged 40", True)
    texts = ["Date of Birth: 1.1.1980, MARRIED, 2 Kinder, Née 1980", "Familienſtand, ledig", "Âge: 40 | Passport no. A1234567", "a@b.de +49 30 1234567", "", "I am German"]
    for text in texts:
        every = [(not k.label, rank, *m.span(1), k.name, k.check) for rank, k, p in ps.COMPILED for m in p.finditer(text, overlapped=True)]
        assert set(every) <= set(ps.candidates(text))


def test_personal_rules_of_the_lint_as_without_the_test_for_words(spark):
    texts = [(1, "Date of Birth: 1.1.1980, MARRIED, 2 Kinder, Née 1980"), (2, "Âge: 40 | Passport no. A1234567, STAATSANGEHÖRIGKEIT"), (3, None), (4, "nothing"), (5, "Familienſtand")]
    df = spark.createDataFrame(texts, "doc_id int, raw string")
    quick = li.l3_personal_data(df, F.lit("text"), "raw")
    plain = li.l3_personal_data(df, F.lit("text"), "raw", [(c, k, p + "(?:)") for c, k, p in li.PERSONAL_RULES])
    assert sorted(map(tuple, quick.collect())) == sorted(map(tuple, plain.collect())) != []
    assert "Contains" in plan(quick)


def test_arrays_are_made_once_before_an_explode(spark, tmp_path):
    spark.createDataFrame([("b a",)], "t string").write.parquet(str(tmp_path / "t"))
    made = spark.read.parquet(str(tmp_path / "t")).select(F.split("t", " ").alias("w"))
    assert "size(split" not in plan(made.select(F.explode(tx.as_made("w"))))


def test_rows_behind_one_exchange_are_the_same(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 1, None), (1, None, "a"), (2, 3, "b")], "doc_id int, ix int, t string")
    assert sorted(map(str, worked_out_once(df, "doc_id", "ix").collect())) == sorted(map(str, df.collect()))


def test_pairs_dealt_by_message_move_once(spark):
    a = spark.createDataFrame([(1, 2), (1, 3)], "m int, r int")
    days = spark.createDataFrame([(1, "x")], "m int, day string")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = lk.evidence_scores([("zeta", a, F.lit(5)), ("beta", a.where("r = 2"), F.lit(20))], "m", "r", ("m",)).join(days, "m")
        text = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert text.count("Exchange hashpartitioning") == 2
    assert sorted(map(tuple, df.collect())) == [(1, 2, 25, "beta+zeta", "x"), (1, 3, 5, "zeta", "x")]


def test_text_helpers_give_what_their_plain_forms_give(spark):
    texts = ["Two 3-day trips — and 12% more.", "", "  ", "--- ... x", "aed12 AED the der", "Zwölf und DIE needs s sings lenses", "٣ staff", "a\tb\u00a0c", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain_count = F.size(F.filter(F.split("t", r"\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]")))
    marked = F.exists(tx.letter_words("t"), lambda w: w.isin(*tx.CURRENCY_WORDS, *tx.SPELLED_FIGURES))
    rows = df.select("t", plain_count.alias("n"), tx.word_count("t").alias("n2"), F.transform(tx.words("t"), tx.stem).alias("s"), tx.stems("t").alias("s2"), marked.alias("m"),
                     F.lower("t").rlike(tx.word_pattern(tx.CURRENCY_WORDS + tx.SPELLED_FIGURES)).alias("m2")).collect()
    assert [(r["n"], r["s"], r["m"]) for r in rows] == [(r["n2"], r["s2"], r["m2"]) for r in rows]
    assert [r["m"] for r in rows[:6]] == [True, False, False, False, True, True]


def test_skills_of_a_document_are_compared_in_its_row(spark):
    rows = [(1, ["market analysis", "Analysis", "analysis of market", "x"]), (1, ["market analysis", "Analysis", "analysis of market", "x"]), (2, ["alpha", "Alpha", None, "Beta"]),
            (None, ["one", "one"]), (3, None), (3, ["gamma"]), (4, ["Delta"]), (4, ["Other", "Delta force"])]
    out = li.l7_skills(spark.createDataFrame(rows, "doc_id int, skills array<string>"))
    text = plan(out)
    assert "Join" not in text and text.count("Aggregate") == 1
    low = [(1, "skills.0", "market analysis"), (1, "skills.2", "analysis of market"), (1, "skills.3", "x")] * 2 + [(2, "skills.0", "alpha"), (3, "skills.0", "gamma"), (None, "skills.0", "one"), (None, "skills.1", "one")]
    inside = [(1, "skills.0", "skills.2"), (1, "skills.1", "skills.0"), (2, "skills.0", "skills.1"), (4, "skills.0", "skills.1")]
    assert sorted(map(str, ((r["doc_id"], r["path"], r["hit"]) for r in out.collect()))) == sorted(map(str, low + inside))


def test_a_rule_works_out_once_what_fails(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, t string")
    out = li.instances(rows, [li.rule("HDR-01", F.reverse("t") == "a", "p", F.col("t"))])
    assert plan(out).count("reverse(") == 1
    assert [tuple(r) for r in out.collect()] == [(1, "HDR-01", "high", "p", "a")]
