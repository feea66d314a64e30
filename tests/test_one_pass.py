"""Work that is done once: documents linted, postings read, texts cleaned, pairs gathered."""
from datetime import date

from pyspark.sql import functions as F

from dossierflow import catalog
from dossierflow.operators import links as lk
from dossierflow.operators import postings as po
from dossierflow.queries import load_all

load_all()
SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rule_coverage_lints_once(spark):
    df = catalog.QUERIES["e11_rule_coverage"](spark, SF)
    assert plan(df).count("MapInArrow") == 1
    assert {(r["check_id"], r["problem"]) for r in df.collect()} >= {("OLD-0", "stale"), ("OLD-1", "stale"), ("OLD-2", "stale")}


def test_items_of_postings_are_read_once(spark):
    assert plan(catalog.QUERIES["s9_posting_to_verdict"](spark, SF)).count("posexplode") == 4


def test_brackets_leave_an_item_once(spark):
    rows = spark.createDataFrame([(1, "fluent German (spoken); 3 years of trade")], "id int, s string")
    items = po.requirement_items(rows, ["id"], "s", F.lit(True))
    assert plan(items).count(r"\([^)]*\)") == 1
    assert [(r["type"], r["years"], r["language"]) for r in items.orderBy("item_ix").collect()] == [("language", None, "german"), ("years", 3, None)]


def test_items_that_share_a_place_are_taken_together(spark):
    """Keys may repeat: a skill is shown when all items of its place are; a key without tokens or languages proves nothing."""
    items = spark.createDataFrame([(1, 0, "skill", "must", "planning", None, None, 0), (1, 0, "skill", "must", "customs", None, None, 0), (2, 0, "skill", "must", "planning", None, None, 0),
                                   (3, 0, "language", "must", "", None, "german", 4), (4, 0, "skill", "must", "ab", None, None, 0)],
                                  "id int, item_ix int, type string, strength string, field string, years int, language string, level int")
    people = spark.createDataFrame([(k, 1, "Other", False) for k in (1, 2, 3, 4)], "id int, years_held int, nationality string, has_degree boolean")
    skills = spark.createDataFrame([(1, "planned"), (1, "planning"), (2, "plans"), (2, "planning"), (None, "customs")], "id int, token string")
    langs = spark.createDataFrame([(3, "german", 3), (3, "german", 4), (3, None, 5)], "id int, language string, held int")
    got = {r["id"]: (r["score"], r["verdict"]) for r in po.assess_fit(items, "id", people, skills, langs).collect()}
    assert got == {1: (0, "skip"), 2: (100, "apply"), 3: (100, "apply"), 4: (0, "skip")}


def test_late_records_leave_before_the_joins(spark):
    """Records begun after the newest message are no one's match, but count where a subject is shared; ids may repeat and dates be null."""
    messages = [(1, "Re: order 5", "x", "a.example", [], date(2024, 1, 5)), (2, "Re: order 6", "x", "a.example", [], date(2024, 1, 1))]
    kind = "message_id int, subject string, text string, from_domain string, threads array<string>, at date"
    records = [(k, "", s, "", "", "", [], since) for k, s, since in (
        (10, "order 5", date(2024, 1, 6)), (11, "order 5", date(2024, 2, 1)), (12, "order 6", None), (13, "order 6", date(2024, 3, 1)), (13, "other", date(2024, 1, 1)))]
    r = spark.createDataFrame(records, "record_id int, ref string, subject string, domain string, company string, role string, msg_ids array<string>, since date")

    def links(rows):
        df = lk.message_signals(spark.createDataFrame(rows, kind), r, "^gmail", "^ats")
        return df, sorted(tuple(x) for x in df.collect())

    df, got = links(messages)
    assert "scalar-subquery" in plan(df)
    assert got == [(1, 10, 20, "shared subject"), (2, 12, 20, "shared subject"), (2, 13, 20, "shared subject")]
    # a message without a date may meet any record
    _, got = links([*messages, (3, "Re: order 5", "x", "a.example", [], None)])
    assert [x for x in got if x[0] == 3] == [(3, 10, 20, "shared subject"), (3, 11, 20, "shared subject")]


def test_signals_meet_in_one_shuffle(spark):
    a = spark.createDataFrame([(1, 2), (1, 2), (1, 3)], "m int, r int")
    b = spark.createDataFrame([(1, 2, 70), (1, 2, 20), (1, 2, 20)], "m int, r int, p int")
    df = lk.evidence_scores([("zeta", a, F.lit(5)), ("beta", b, F.col("p"))], "m", "r")
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, df.collect())) == [(1, 2, 95, "beta+zeta"), (1, 3, 5, "zeta")]
