"""Nothing is capped, cut or decided by size; no job runs while a plan is built."""
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from dossierflow import catalog
from dossierflow.functions import dates as dt
from dossierflow.functions import profiles as pf
from dossierflow.operators import lexicon as lx
from dossierflow.operators import links as lk
from dossierflow.operators import listings as ls
from dossierflow.operators import merge as mg
from dossierflow.operators import messages as ms
from dossierflow.queries import load_all
from dossierflow.sources import exports as ex
from dossierflow.sources import feeds as fd

load_all()
SF = "/root/testdata/sf0.001"


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def other_input(spark, tmp_path, **tables):
    """The path of an input of the smallest data with some tables replaced."""
    for p in Path(SF).glob("*.parquet"):
        if p.stem in tables:
            tables[p.stem].write.parquet(str(tmp_path / p.name))
        else:
            (tmp_path / p.name).symlink_to(p)
    return str(tmp_path)


#: These write tables on the way (rounds of matches, decisions after a ledger) or run a stream.
STEPWISE = {"d11_match_roles", "k5_undo_confirm", "k8_stream_records"}


def test_building_a_query_starts_no_job(spark):
    sc = spark.sparkContext
    started = []
    for name, run in catalog.QUERIES.items():
        if name in STEPWISE:
            continue
        sc.setJobGroup(f"build-{name}", name)
        before = set(sc.statusTracker().getJobIdsForGroup(f"build-{name}"))
        run(spark, SF).schema
        after = set(sc.statusTracker().getJobIdsForGroup(f"build-{name}"))
        # reading the schema of a parquet folder is Spark's own first job
        jobs = [j for j in after - before if (info := sc.statusTracker().getJobInfo(j)) and any(
            "parquet" not in (sc.statusTracker().getStageInfo(s).name if sc.statusTracker().getStageInfo(s) else "parquet") for s in info.stageIds)]
        started += [name] * bool(jobs)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert started == []


def test_wide_exports(spark, tmp_path):
    columns = [f"Extra {i}" for i in range(50)] + ["Company Name", "Title", "Started On"]
    values = [str(i) for i in range(50)] + ["Acme, Inc", "Lead", "Jan 2020"]
    path = tmp_path / "Positions.csv"
    path.write_text(",".join(columns) + "\n" + ",".join(f'"{v}"' for v in values) + "\n")
    rows = ex.read_export(spark, str(path), "positions").collect()
    assert [(r["company"], r["title"], r["start"]) for r in rows] == [("Acme, Inc", "Lead", "Jan 2020")]


def test_long_records_are_one_text(spark):
    rows = spark.range(1500).select(F.lit(1).alias("k"), F.col("id").alias("ix"), F.concat(F.lit("row "), F.col("id").cast("string")).alias("text"))
    got = mg.document_text(rows, "k", "ix", "text").collect()
    assert len(got) == 1 and got[0]["body"].split("\n") == [f"row {i}" for i in range(1500)]


def test_merges_keep_everything(spark):
    base = spark.createDataFrame([(1, "h", "s", [f"skill {i}" for i in range(48)], [f"line {i}" for i in range(12)])], "k int, h string, s string, sk array<string>, ls array<string>")
    add = spark.createDataFrame([(1, "", "", ["skill 48", "skill 3"], ["line 12", "LINE 3", "line 12", ""])], base.schema)
    got = mg.merge_profiles(base, add, "k", ["h"], ["s"], "sk", "ls").first()
    assert got["sk"][48:] == ["skill 48"] and got["ls"][12:] == ["line 12", "line 12"] and got["gained_lines"] == 2
    capped = mg.merge_profiles(base, add, "k", ["h"], ["s"], "sk", "ls", skill_cap=48, line_cap=12).first()
    assert len(capped["sk"]) == 48 and len(capped["ls"]) == 12


def test_contained_lines_take_a_large_second_side(spark):
    many = spark.range(200_001).select(F.col("id").alias("b"), F.concat(F.lit("line number "), F.col("id").cast("string"), F.lit(" of a file with very many lines")).alias("y"))
    few = spark.createDataFrame([(7, "we saw line number 7 of a file with very many lines there"), (8, "number 8 of a file with very many lines here")], "a int, x string")
    got = lk.contained_lines(few, ["a"], "x", many, ["b"], "y")
    assert {(r["a"], r["b"]) for r in got.collect()} == {(7, 7)}


def test_places_of_late_lines(spark):
    from dossierflow.queries.listings import must_candidates
    from dossierflow.tables import Tables

    tables = Tables(spark, SF)
    concept = tables.lexicon.orderBy("concept").first()["concept"]
    tables.__dict__["documents"] = spark.createDataFrame([(1, "\n".join(["x"] * 30_000 + [f"word {concept} end"]))], "doc_id long, text string")
    row = must_candidates(tables).where(F.col("concept") == concept).first()
    assert (row["first_pos"] >> 32, row["first_pos"] & 0xFFFFFFFF) == (30_000, 1)


def test_message_keys_read_the_whole_reply(spark):
    head = "word " * 100
    df = spark.createDataFrame([(1, head + "one"), (2, head + "two")], "i int, t string")
    keys = df.select(ms.content_key(F.lit("a@x.test"), F.lit("s"), "t").alias("k")).distinct().count()
    assert keys == 2


CASES = [
    ("Thank you for the interview invitation, we want to arrange an interview next week.", "interview"), ("The position has now been filled.", "rejection"),
    ("We will not be progressing your application.", "rejection"), ("Termin bitte verschieben", "interview"), ("We may contact you to arrange an interview.", "other"),
    ("In May contact us to arrange an interview.", "interview"), ("We are pleased to offer you the position.", "offer"),
    ("We are pleased to offer you an interview.", "interview"), ("Die Stelle ist inzwischen anderweitig besetzt.", "rejection"), ("Nous avons bien reçu votre candidature.", "ack"),
    ("نعتذر", "rejection"), ("عرض عمل", "offer"), ("Bitte senden Sie uns Ihr Zeugnis.", "info"), ("I am on annual leave until Monday.", "auto_reply"),
    ("If you do not hear from us, please accept that your application has not been successful.", "other"),
    ("We never ask for payment for an offer letter.", "other"), ("Hello there.", "other"),
    ("x " * 300 + "Your mail has been delayed.", "other"),
]


@pytest.mark.parametrize("text,cls", CASES)
def test_message_phrases(spark, text, cls):
    df = spark.createDataFrame([("subject", text, False, False, False)], "subject string, text string, auto_submitted boolean, is_report boolean, is_receipt boolean")
    assert ms.classify(df).first()["cls"] == cls


def test_quoted_originals(spark):
    for quote in ("Le lun. 3 mars 2025 à 10:00, A B <a@b.test> a écrit :", "On Monday A B wrote:", "Am Montag schrieb A B:", "-----Message d'origine-----"):
        assert one(spark, ms.strip_quoted(F.lit(f"Bonjour\n\n{quote}\nold text"))) == "Bonjour"


def test_years_and_terms(spark):
    assert one(spark, dt.end_year(F.lit("known site 2009 - 2011"))) == 2011
    assert one(spark, dt.end_year(F.lit("presented 2010"))) == 2010
    assert one(spark, dt.end_year(F.lit("2009 – present"))) == 9999
    assert one(spark, pf.term_at(F.lit("a post-AI world"), F.lit("AI"))) == -1
    assert one(spark, pf.term_at(F.lit("an AI world"), F.lit("AI"))) == 3


def test_headers_with_copies_and_blank_lines(spark):
    raw = "\n\nFrom: a@x.test\nTo: b@x.test\nCc: c@x.test\nCc: d@x.test\nSubject: Hello\n\nBody: text"
    got = fd.read_message_headers(spark.createDataFrame([(raw,)], "t string"), "t").first()
    assert (got["from"], got["to"], got["cc"], got["subject"], got["body"]) == ("a@x.test", "b@x.test", "c@x.test, d@x.test", "Hello", "Body: text")


def test_a_day_written_again_replaces_itself(spark, tmp_path):
    rows = spark.createDataFrame([("s1", 1), ("s1", 2), ("s2", 3)], "source string, id int")
    path = str(tmp_path / "snapshots")
    fd.write_snapshot(rows, path, "2024-01-01")
    fd.write_snapshot(rows.where("id > 1"), path, "2024-01-02")
    fd.write_snapshot(rows, path, "2024-01-01")
    got = spark.read.parquet(path).groupBy("snapshot_date").count().collect()
    assert sorted((str(r[0]), r[1]) for r in got) == [("2024-01-01", 3), ("2024-01-02", 2)]


def test_gram_keys_tell_lengths_apart(spark):
    keys = one(spark, lx.gram_keys(F.lit("a b c"), 3))
    assert len(set(keys)) == 6


def test_sql_sentences_agree_with_the_function(spark):
    from dossierflow.functions import text as tx
    from dossierflow.functions.sql import register

    register(spark)
    for text in ("One. Two! Three", "He met Dr. Smith. They left.", "z. B. das. Und mehr.", "It's e.g. This one. Yes?"):
        a, b = spark.createDataFrame([(text,)], "t string").select(F.expr("df_sentence_count(t)").alias("a"), F.size(tx.sentences("t")).alias("b")).first()
        assert a == b, text


def test_limiter_orders_all_chunks_of_a_key(spark):
    import datetime as d

    from dossierflow.streaming import jobs

    start = d.datetime(2024, 1, 1)
    rows = [("k", i, start + d.timedelta(seconds=i)) for i in range(400)]
    events = spark.createDataFrame(rows[::-1], "user string, id long, ts timestamp")
    path = f"{spark.conf.get('spark.checkpoint.dir')}/limiter-{d.datetime.now().timestamp()}"
    events.coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        stream = jobs.admit_stream(spark.readStream.schema(events.schema).parquet(path), "user", "ts", "id", 3, 100)
        q = stream.writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = {r["id"] for r in spark.table("limited").where("accepted").collect()}
    assert got == {i for i in range(400) if i % 100 < 3}


def test_feed_files_and_mappings(spark, tmp_path):
    import json

    bodies = {
        "slug-feed": {"data": [{"title": " Lead ", "company_name": "Acme", "location": "", "remote": True, "url": "https://x.test/1", "slug": "lead-1", "created_at": 1700000000, "description": "<p>Run it</p>"}]},
        "salary-feed": {"results": [{"id": "7", "title": "GM", "company": {"display_name": "B"}, "location": {"display_name": "Bern"}, "redirect_url": "https://x.test/2",
                                     "created": "2026-01-02T10:00:00Z", "salary_min": 100000, "salary_max": 120000, "salary_is_predicted": "0", "description": "d"}]},
        "snippet-feed": {"jobs": [{"id": 9, "title": "MD", "company": "C", "location": "Dubai", "link": "ae.x.test/9", "updated": "2026-02-03T00:00:00", "salary": "10k", "snippet": "<b>s</b>"}]},
        "remote-feed": {"jobs": [{"id": 4, "title": "T", "company_name": "D", "candidate_required_location": None, "url": "https://x.test/4", "publication_date": "2026-03-04", "description": "x"}]},
    }
    got = {}
    for m in (fd.SLUG_FEED, fd.SALARY_FEED, fd.SNIPPET_FEED, fd.REMOTE_FEED):
        path = tmp_path / f"{m.source}.json"
        path.write_text(json.dumps(bodies[m.source]))
        rows = fd.read_feed(spark, str(path), fd.FEED_RECORDS[m.source])
        got[m.source] = fd.normalize_feed(rows.select("pos", "record"), "record", m).first()
    a, b, c, d = got.values()
    assert (a["title"], a["location"], a["ref"], a["posted"], a["text"]) == ("Lead", "Remote / Europe", "lead-1", "2023-11-14", "Run it")
    assert (b["company"], b["ref"], b["salary"], b["posted"]) == ("B", "ADZ-7", "100,000 – 120,000 / year", "2026-01-02")
    assert (c["url"], c["ref"], c["salary"], c["text"]) == ("https://ae.x.test/9", "JOOBLE-9", "10k", "s")
    assert (d["location"], d["ref"], d["posted"]) == ("Remote", "4", "2026-03-04")


def test_titles_with_city_parts_and_single_demands(spark):
    from dossierflow.functions import titles as tt

    r = one(spark, tt.clean_role_title(F.lit("Finance Director | Dubai, United Arab Emirates"), None, F.lit("Dubai, United Arab Emirates, x")))
    assert r["title"] == "Finance Director"
    r = one(spark, tt.clean_role_title(F.lit("HR Officer - Emirati")))
    assert (r["title"], r["qualifiers"]) == ("HR Officer", ["Emirati national"])


def test_files_that_are_never_read(spark):
    names = ["Positions.csv", "Saved Items.csv", "private_identity.csv", "Causes You Care About.csv", "Logins.csv", "Hashtag_Follows.csv", "Jobs/Positions.csv", "Skills.csv"]
    files = spark.createDataFrame([(n, ["a"], 1) for n in names], "path string, header array<string>, n_records int")
    got = {r["path"]: (r["kind"], r["never"]) for r in ex.classify_export_files(files).collect()}
    assert got["Positions.csv"] == ("positions", False) and got["Skills.csv"] == ("skills", False)
    assert all(got[n] == (None, True) for n in names if n not in ("Positions.csv", "Skills.csv"))


def test_roles_of_several_words_rank(spark):
    from dossierflow.operators import listings as ls

    rows = spark.createDataFrame([(1, "Managing Director GCC", "we run a plant"), (2, "Director", "managing a plant and a fleet"), (3, "Clerk", "plant fleet")], "id int, title string, text string")
    terms = spark.createDataFrame([("managing director", "role"), ("plant", "skill"), ("fleet", "skill")], "term string, kind string")
    hits = ls.profile_hits(rows, "id", "title", "text", terms, max_words=2)
    assert {(r["id"], r["role_hits"], r["skill_hits"]) for r in hits.collect()} == {(1, 1, 1), (2, 0, 2), (3, 0, 2)}
    ranked = ls.rank_listings(rows, hits, "id", F.lit(False), F.lit(False))
    assert [r["id"] for r in ranked.collect()] == [1, 3, 2]
    assert [r["id"] for r in ls.rank_listings(rows, hits, "id", F.lit(False), F.lit(False), strict=True).collect()] == [1]


def test_items_with_several_languages_and_nationality(spark):
    from dossierflow.operators import postings as po

    text = "Requirements\n- Fluent English and Arabic language skills\n- UAE nationals preferred\nWe offer\nGerman courses"
    items = po.parse_posting(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").collect()
    assert {(r["type"], r["language"], r["field"], r["strength"]) for r in items} == {
        ("language", "english", "", "must"), ("language", "arabic", "", "must"), ("nationality", None, "uae", "nice")}


def test_source_health_reads_all_documents(spark, tmp_path):
    docs = [(1, "x" * 70, "en", "a", 70), (2, "x" * 7, "en", "b", 7), (3, "x" * 61, "en", "b", 61), (4, "x" * 77, "en", "c", 77), (5, "x" * 77, "en", "a", 77)]
    given = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(5, 1, 1), (4, 0, 1)], spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").schema)
    got = catalog.QUERIES["e4_source_health"](spark, other_input(spark, tmp_path, documents=given, labels=labels)).collect()
    assert sorted(map(tuple, got)) == [("a", 2, 1, "ok"), ("b", 2, 0, "error"), ("c", 1, 0, "empty")]


def test_sources_seen_only_in_results(spark):
    log = spark.createDataFrame([("a", 3, False)], "source string, n_found int, failed boolean")
    got = ls.source_health(log, spark.createDataFrame([("z",), ("z",)], "source string")).collect()
    assert sorted(map(tuple, got)) == [("a", 3, 0, "empty"), ("z", 0, 2, "ok")]


def test_phones_of_both_forms_in_every_document(spark, tmp_path):
    texts = [(1, "call 0049 30 1234567 now"), (2, "or +49 30 7654321."), (3, "no number"), (4, None), (5, "004930 1234567, +4930 7654321")]
    given = spark.createDataFrame([(*t, "en", "a", 1) for t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = catalog.QUERIES["s21_phones"](spark, other_input(spark, tmp_path, documents=given)).collect()
    assert {r.doc_id: r.phones for r in got} == {1: "0049 30 1234567", 2: "+49 30 7654321", 3: "", 4: "", 5: "+4930 7654321|004930 1234567"}


def test_evidence_in_any_language_counts(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = []
    for k, lang in enumerate((F.lit("de"), F.lit(None).cast("string"))):
        (at := tmp_path / str(k)).mkdir()
        found.append({r.concept for r in catalog.QUERIES["d5_missing_evidence"](spark, other_input(spark, at, documents=docs.withColumn("lang", lang))).collect()})
    assert found[0] == found[1]


def test_hosts_of_one_beginning_are_different_names(spark, tmp_path):
    first = spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").limit(2)
    url = F.concat(F.lit("https://acmecorp"), F.row_number().over(Window.orderBy("page_id")).cast("string"), F.lit(".example.com/"))
    got = catalog.QUERIES["b17_pick_official_site"](spark, other_input(spark, tmp_path, pages=first.withColumn("url", url))).collect()
    assert {r.name: r.url for r in got} == {f"acmecorp{k}": f"https://acmecorp{k}.example.com/" for k in (1, 2)}


def test_checks_over_roles_and_places_fire(spark):
    found = {r["check_id"] for r in catalog.QUERIES["lint_all_with_roles"](spark, SF).select("check_id").distinct().collect()}
    assert found >= {"ATS-02", "BUL-01", "DOC-03", "EXP-01", "EXP-02", "EXP-03", "EXP-04", "EXP-05", "EXP-06", "EXP-07", "EXP-08", "EXP-09", "EXP-10", "EXP-12", "HL-02", "MKT-02", "SUM-05", "SUM-08"}
