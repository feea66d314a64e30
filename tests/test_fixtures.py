"""Domain fixtures: expected values stated with their inputs."""
import datetime as d

import pytest
from pyspark.sql import functions as F

from dossierflow.functions import dates as dt
from dossierflow.functions import html as hx
from dossierflow.functions import mailboxes as mb
from dossierflow.functions import profiles as pf
from dossierflow.functions import text as tx
from dossierflow.functions import titles as tt
from dossierflow.functions import urls as ux
from dossierflow.operators import intervals as iv
from dossierflow.operators import listings as ls
from dossierflow.operators import messages as ms
from dossierflow.operators import pages as pg
from dossierflow.operators import postings as po
from dossierflow.operators.scale import keep_first
from dossierflow.plans import catalogue as cat
from dossierflow.plans import lint as li
from dossierflow.sources import exports as ex
from dossierflow.sources import feeds as fd


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")


def test_feed_mapping(spark):
    m = fd.FeedMapping("f", "title string, salary_min double, salary_max double, salary_is_predicted int, link string, created string, snippet string",
                       company="NULL", location="NULL", url="link", ref="NULL", text="snippet", salary_min="salary_min", salary_max="salary_max", salary_predicted="salary_is_predicted")
    rows = spark.createDataFrame([(
        '{"title":" a ","salary_min":120000,"salary_max":150000,"salary_is_predicted":0,"link":"ae.jobs.test/jdp/99","created":"2026-11-18T08:00:00Z","snippet":"<b>Lead</b> the GCC business"}',), (
        '{"title":"b","salary_min":90000,"salary_max":90000,"salary_is_predicted":1,"link":"https://x.test","created":"","snippet":""}',)], "j string")
    a, b = fd.normalize_feed(rows, "j", m).orderBy("title").collect()
    assert (a["salary"], a["url"], a["posted"], a["text"]) == ("120,000 – 150,000 / year", "https://ae.jobs.test/jdp/99", "2026-11-18", "Lead the GCC business")
    assert b["salary"] == "" and b["url"] == "https://x.test"


def test_contact_resolution_never_guesses(spark):
    rows = [(1, "indeed", "", "", ""), (2, "desk", "", "", ""), (3, "desk", "Send your CV to jobs@acme.ae by Friday.", "", ""),
            (4, "x", "", "hr@acme.ae", "Scraped Live from Company Website (acme.ae)"), (5, "x", "", "careers@acme.ae", "Corporate HR Mailbox (acme.ae)"), (6, "x", "", "a@made-up.test", "")]
    listings = spark.createDataFrame(rows, "id int, source string, text string, to_address string, via string")
    desks = spark.createDataFrame([("desk", "desk@agency.test", "Desk")], "source string, desk_email string, desk_via string")
    got = {r["id"]: (r["email"], r["via"]) for r in ls.resolve_contact(listings, "id", "text", desks, fabricated="@made-up").collect()}
    assert [got[i][0] for i in range(1, 7)] == ["", "desk@agency.test", "jobs@acme.ae", "hr@acme.ae", "", ""]
    assert "Extracted" in got[3][1]


def test_listing_key_first_wins(spark):
    rows = [(1, "https://x.test/a?u=1", "R1"), (2, "https://x.test/b", "r1"), (3, "https://x.test/a/", ""), (4, "https://x.test/a#t", ""), (5, "https://x.test/a?z=9", "")]
    df = spark.createDataFrame(rows, "pos int, url string, ref string").withColumn("k", ls.listing_key("ref", "url"))
    assert sorted(r["pos"] for r in keep_first(df, ["k"], [F.col("pos")]).collect()) == [1, 3, 4]


def test_card_run(spark):
    runs = ["3 weeks ago General Manager Place of work : Bern Workload : 100% Contract type : Permanent position Hotelis SA (Bern) Is this job relevant to you?",
            "Yesterday Sales Head Place of work : Basel Workload : 80% Contract type : Permanent position TORMAX Easy apply"]
    labels = [("place", "Place of work"), ("workload", "Workload"), ("contract", "Contract type")]
    out = pg.split_labelled_run(texts(spark, runs), "v", labels, r"today|yesterday|[0-9]+\s+(?:days?|weeks?|months?)\s+ago", ["Permanent position", "Freelance"],
                                ["Promoted", "Easy apply"], r"Is this job relevant to you\?").orderBy("i").collect()
    assert [out[0][c] for c in ("age", "title", "place", "workload", "contract", "company")] == ["3 weeks ago", "General Manager", "Bern", "100%", "Permanent position", "Hotelis SA (Bern)"]
    assert out[1]["company"] == "TORMAX"


def test_navigation_filter(spark):
    rows = [("/a.pdf", "Filetype: pdf Research Manager (Part Time Role) (m/f/d) Filesize: 217.30 kb"), ("/b", "Interim General Manager (m/f/d) Middle East"),
            ("/c", "Managing Director (m/f/d) GCC"), ("/d", "Home"), ("/e", "Privacy"), ("/f", "Newsletter")]
    df = spark.createDataFrame(rows, "href string, label string")
    assert sorted(r["title"] for r in pg.filter_navigation_links(df).collect()) == [
        "Interim General Manager (m/f/d) Middle East", "Managing Director (m/f/d) GCC", "Research Manager (Part Time Role) (m/f/d)"]


def test_reader_envelope_and_entities(spark):
    body = '{"code":200,"data":{"title":"T","content":"**Bold** text\\n\\n\\n\\n* one\\n* two"}}'
    assert one(spark, pg.unwrap_reader_envelope(F.lit(body))) == "T\n\nBold text\n\n• one\n• two"
    assert one(spark, pg.unwrap_reader_envelope(F.lit("Title\n\n* one\n* two"))) == "Title\n\n• one\n• two"
    assert one(spark, hx.to_text(F.lit("<p>a&nbsp;&amp;&#x20AC;&#8364; b</p>"))) == "a &€€ b"


@pytest.mark.parametrize("url,ok", [("https://example.com:443/", True), ("http://10.1.2.3/", False), ("http://127.0.0.1/", False), ("http://x.test:25/", False),
                                    ("http://x.test:6379/", False), ("http://x.test:8080/", False), ("http://169.254.1.1/", False), ("ftp://x.test/", False), ("http://[::1]/", False), ("http://8.8.8.8/", True)])
def test_public_http(spark, url, ok):
    assert one(spark, ux.is_public_http(F.lit(url))) is ok


def test_required_language(spark):
    cases = [("General Manager", "Fluent Arabic and English required.", "arabic"), ("GM", "Arabic-speaking candidates preferred.", "arabic"),
             ("Contract General Manager", "Home English Jobs in Abu Dhabi.", "english"), ("MD", "Reporting to Germany HQ.", "english"),
             ("Operations Director", "Business-level German is essential.", "german"), ("Geschäftsführer (m/w/d)", "Ihre Aufgaben: Leitung", "german"),
             ("Regional GM", "Expand into the Chinese market.", "english"), ("Directeur", "Native French speaker.", "french")]
    df = spark.createDataFrame(cases, "t string, x string, want string")
    assert [r["want"] for r in df.collect()] == [r["got"] for r in df.select(tt.required_language("t", "x").alias("got")).collect()]


def test_skill_lines(spark):
    cases = {"Market intelligence, analysis and penetration": ["Market intelligence, analysis and penetration"], "Negotiation, Budgeting, Team leadership": ["Negotiation", "Budgeting", "Team leadership"],
             "Strong IT and AI proficiencies.": ["Strong IT and AI proficiencies"], "P&L Ownership, M&A Integration, Board Reporting": ["P&L Ownership", "M&A Integration", "Board Reporting"],
             "ERP/SAP, CAPEX/OPEX control": ["ERP/SAP", "CAPEX/OPEX control"], "Strategy • Operations • Turnaround": ["Strategy", "Operations", "Turnaround"],
             "Lean Six Sigma | Supply Chain; Procurement": ["Lean Six Sigma", "Supply Chain", "Procurement"]}
    got = texts(spark, list(cases)).orderBy("i").select(pf.split_skills("v").alias("s")).collect()
    assert [r["s"] for r in got] == list(cases.values())


def test_interval_rules(spark):
    roles = spark.createDataFrame([(1, 1, 10, 20), (1, 2, 21, 30), (1, 3, 36, 40), (2, 1, 10, 20), (2, 2, 27, 30), (3, 1, 10, 20), (3, 2, 34, 50), (3, 3, 49, 60)], "k int, r int, from_ix int, to_ix int")
    gaps = {(g["k"], g["trailing"]): (g["months"], g["sev"]) for g in iv.timeline_gaps(roles, "k", 62).collect()}
    assert (1, False) not in gaps  # adjacent months merge, five empty months are no gap
    assert gaps[(2, False)] == (6, "low") and gaps[(3, False)] == (13, "med") and gaps[(1, True)] == (22, "med")
    over = {(r["k"], r["r"]): r["n_overlaps"] for r in iv.overlap_counts(roles, "k", "r").collect()}
    assert over == {(3, 2): 1, (3, 3): 1}


def test_ranges(spark):
    cases = ["03/2021 - PRESENT", "06/2017 – 02/2021", "Sept 2019 to Jan 2020", "since 2015", "2019-03", "Mrz 2005 – ?", "Mär 2005 – heute (Teilzeit)"]
    got = texts(spark, cases).orderBy("i").select(dt.parse_range("v").alias("r")).collect()
    side = lambda s: None if s is None else ("open" if s["is_open"] else (s["y"], s["m"]))
    assert [(side(r["r"]["from"]), side(r["r"]["to"])) for r in got] == [
        ((2021, 3), "open"), ((2017, 6), (2021, 2)), ((2019, 9), (2020, 1)), ((2015, None), "open"), ((2019, 3), (2019, 3)), (None, None), ((2005, 3), "open")]
    assert got[6]["r"]["note"] == "Teilzeit"
    exported = texts(spark, ["Jan 2019", "2019", "2019-01", "01/2019", "Sept 2019"]).orderBy("i").select(dt.export_month("v").alias("x")).collect()
    assert [r["x"] for r in exported] == ["Jan 2019", "2019", "Jan 2019", "Jan 2019", "Sep 2019"]


def test_read_export_files(spark, tmp_path):
    (tmp_path / "Positions.csv").write_text('﻿Notes: "exported"\nCompany Name,Title,Description,Location,Started On,Finished On\n"Acme, Inc","Head ""of"" Sales","line one\nline two",Dubai,Jan 2019,\n', "utf-8")
    row = ex.read_export(spark, str(tmp_path), "positions").collect()
    assert len(row) == 1
    assert (row[0]["company"], row[0]["title"], row[0]["description"], row[0]["start"], row[0]["end"]) == ("Acme, Inc", 'Head "of" Sales', "line one\nline two", "Jan 2019", "")


def test_message_classes(spark):
    cases = [("Re: role", "We would like to invite you to an interview next week.", "interview", 0.85), ("Re: role", "Thank you for your application. We would like to invite you for an interview.", "interview", 0.45),
             ("Re: role", "We regret to inform you that you have not been selected.", "rejection", 0.85), ("Re", "If you do not hear from us, please accept that you have not been successful.", "other", 0.3),
             ("Re", "Only shortlisted: if shortlisted we will arrange an interview. We have received your application.", "ack", 0.8), ("Undeliverable: hello", "", "bounce", 0.95),
             ("Re", "We never ask for payment for an offer letter.", "other", 0.3), ("Re", "We are pleased to offer you the position.", "offer", 0.8), ("Automatic reply", "I am out of the office.", "auto_reply", 0.85),
             ("Re", "Could you please send us your salary expectations?", "info", 0.75), ("Read: CV", "", "read", 0.45), ("Re", "Unfortunately it took a while.", "rejection", 0.45)]
    df = spark.createDataFrame([(i, s, t, False, False, False) for i, (s, t, _, _) in enumerate(cases)], "i int, subject string, text string, auto_submitted boolean, is_report boolean, is_receipt boolean")
    got = [(r["cls"], r["conf"]) for r in ms.classify(df).orderBy("i").collect()]
    assert got == [(c, f) for _, _, c, f in cases]


def test_stage_rules_match_a_plain_fold(spark):
    """The closed form against the state machine run step by step, for every start and every sequence of three replies."""
    import itertools
    rank = ms.STAGE_RANK
    classes = ["rejection", "bounce", "read", "ack", "offer", "other"]

    def step(s, c):
        if s in ("withdrawn", "rejected"):
            return s
        if c == "rejection":
            return "rejected"
        if c == "bounce":
            return "bounced" if s in ("prepared", "applied") else s
        if c == "read":
            return "applied" if s == "prepared" else s
        if c in ms.FORWARD_RANK:
            return c if rank[c] > rank.get(s, 0) else s
        return "applied" if s in ("prepared", "silent") else s

    rows, want, key = [], {}, 0
    for init in ("draft", "prepared", "applied", "silent", "ack", "withdrawn"):
        for seq in itertools.product(classes, repeat=3):
            s = init
            for i, c in enumerate(seq):
                s = step(s, c)
                rows.append((key, init, i, c))
            want[key] = s
            key += 1
    df = spark.createDataFrame(rows, "k int, init string, ts int, cls string").repartition(7)
    got = {r["k"]: r["stage"] for r in ms.fold_stage(df, ["k"], "cls", "ts", F.col("init")).collect()}
    assert got == want


def test_horizon(spark):
    day = lambda s: F.lit(s).cast("date")
    now = day("2026-11-14")
    assert [one(spark, dt.read_horizon(x, now)) for x in (day("2026-11-01"), day("2026-10-01"), day("2026-01-01"), F.lit(None).cast("date"))] == [
        d.date(2026, 10, 15), d.date(2026, 9, 30), d.date(2026, 7, 17), d.date(2026, 10, 15)]


def test_titles_posters_levels(spark):
    r = one(spark, tt.clean_role_title(F.lit("URGENT HIRING Finance Director (m/w/d) - Acme | Dubai, United Arab Emirates"), F.lit("Acme"), F.lit("Dubai, United Arab Emirates")))
    assert r["title"] == "Finance Director"
    assert [one(spark, tt.poster(F.lit(c)))["kind"] for c in ("", "via Departer — The Headhunter", "via ae.board.test", "Confidential", "Gulf Recruitment", "Acme LLC")] == [
        "unknown", "agency", "nameless", "nameless", "agency", "employer"]
    assert one(spark, tt.seniority(F.lit("General Manager"))) == "executive" and one(spark, tt.seniority(F.lit("Buyer"), F.lit(4))) == "mid"


def test_mailboxes(spark):
    cases = {"careers@acme.com": "apply", "hr.uae@acme.com": "apply", "sales@acme.com": "never", "jordan.sales@acme.com": "general", "acmejobs@acme.com": "apply", "info@acme.com": "general", "maria.lopez@acme.com": "general"}
    got = texts(spark, list(cases)).orderBy("i").select(mb.mailbox_kind("v").alias("k")).collect()
    assert [r["k"] for r in got] == list(cases.values())


def test_requirements(spark):
    s = texts(spark, ["We are looking for someone with at least 5 years of experience in logistics, fluent German and a degree in engineering; MBA preferred"])
    rows = po.requirement_items(s, ["i"], "v", F.lit(True)).orderBy("item_ix").collect()
    assert [(r["type"], r["strength"]) for r in rows][:2] == [("years", "must"), ("language", "must")]
    assert rows[0]["years"] == 5 and rows[1]["language"] == "german" and rows[1]["level"] == 4


def test_figures(spark):
    cases = {"Grew revenue by 18%": True, "Led B2B sales from 2019 to 2021": False, "Founded in 2005": False, "Managed 250 staff": True, "Doubled output": True, "AED portfolio": True, "Sold to G20 states": False}
    got = texts(spark, list(cases)).orderBy("i").select(tx.has_figure("v").alias("f")).collect()
    assert [r["f"] for r in got] == list(cases.values())


def test_catalogue_is_whole():
    rows = cat.checks()
    assert len(rows) == 79 and len({r[0] for r in rows}) == 79
    assert set(cat.GATES) | set(cat.DEFERRED) | set(cat.QUESTION_ONLY) <= {r[0] for r in rows}


def profile_docs(spark, **over):
    base = dict(doc_id=1, doc_lang="en", market="gcc", name="Jo Doe", email="jo@doe.test", phone="+971 50 123 4567", city="Dubai", work_rights="visa", headline="General Manager, Retail", summary="I led 40 staff.",
                langs="English (fluent) · German", refs="on request", edu_b="Diploma availabl", edu_s="", skills=["Budgeting", "Sales"], bullets=["Led budgeting for 12 sites", "Responsible for sales"], career_years=10)
    base.update(over)
    schema = ("doc_id bigint, doc_lang string, market string, name string, email string, phone string, city string, work_rights string, headline string, summary string, langs string, refs string, edu_b string, edu_s string, "
              "skills array<string>, bullets array<string>, career_years int")
    return spark.createDataFrame([tuple(base[c.split()[0]] for c in schema.split(", "))], schema)


def ids(df):
    return sorted({r["check_id"] for r in df.collect()})


def test_lint_document_rules(spark):
    assert ids(li.l1_blank_fields(profile_docs(spark))) == []
    assert ids(li.l1_blank_fields(profile_docs(spark, name="a@b", email="x", phone="12", city="", summary="", headline=""))) == ["HDR-01", "HDR-02", "HL-01", "SUM-01"]
    assert ids(li.l4_shapes_docs(profile_docs(spark, phone="050 123", city="- Dubai"))) == ["ATS-02", "EDU-02", "HDR-03", "LNG-03"]
    assert ids(li.l2_terms_docs(profile_docs(spark, headline="Visionary seeking a role"), {})) == ["HL-03", "HL-05", "SUM-10"]
    got = li.l6_consistency_docs(profile_docs(spark, city="Berlin", summary="15 years of P&L in French"), {"+971": "AE"}, {"berlin": "DE", "dubai": "AE"})
    assert ids(got) == ["HDR-04", "LNG-04", "MET-03", "SUM-06"]
    assert ids(li.l9_languages(profile_docs(spark, edu_s="Gesamtnote gut", summary="und der die das mit für"))) == ["DOC-02", "EDU-03"]


def test_lint_roles_and_lines(spark):
    roles = spark.createDataFrame([(1, 0, "3 years", "Dubai", "03/2021 - 01/2020"), (1, 1, "Sales Manager", "Acme LLC, Dubai", "Jan 2019 – Dec 2019"), (1, 2, "", "Acme Trading", "sometime")],
                                  "doc_id bigint, role_ix int, title string, employer string, dates string").withColumn("pd", dt.parse_range("dates"))
    assert ids(li.l4_shapes_roles(roles, ["dubai", "berlin"], 2026 * 12)) == ["EXP-02", "EXP-03", "EXP-04", "EXP-06"]
    assert ids(li.l1_blank_roles(roles, ["dubai"])) == ["EXP-01", "EXP-10"]
    lines = spark.createDataFrame([(1, 0, "Responsible for the budget", "en"), (1, 1, "major excellent work on the sites", "en"), (1, 2, "Sales Director", "en"), (1, 3, "The company was founded in Dubai 1999.", "en"), (1, 4, "•\tgrew it", "en")],
                                  "doc_id bigint, line_ix int, text string, doc_lang string").withColumn("is_template", F.col("line_ix") == 4).withColumn("n_in_role", F.lit(5)).withColumn("is_current", F.lit(False))
    hits = [(r["check_id"], r["hit"]) for r in li.l2_terms_lines(lines, {}).orderBy("check_id", "hit").collect()]
    assert hits == [("BUL-04", ""), ("BUL-05", "excellent"), ("BUL-05", "major")]
    assert {"ATS-01", "BUL-08", "BUL-09"} <= set(ids(li.l4_shapes_lines(lines)))
    assert ids(li.l10_templates(lines)) == ["ACH-01"]
    pers = spark.createDataFrame([(1, "Nationality: German | Married | born 12.03.1975 | Age: 45 | Passport no: AB12345 | Religion: none | sick leave")], "doc_id bigint, text string")
    assert ids(li.l3_personal_data(pers, F.lit("h"), "text")) == ["HDR-06", "HDR-07", "HDR-08", "HDR-09", "HDR-10", "HDR-12"]


def test_lint_titles_places_references(spark):
    docs = profile_docs(spark, headline="CEO and Managing Director", summary="Led Qatar, the GCC and Germany", refs="Contact Mr. Smith, tel 0501234567", langs="Deutsch (Muttersprache)")
    roles = spark.createDataFrame([(1, 0, "Managing Director", "Jan 2019 – heute", "en"), (1, 1, "Deputy General Manager", "2015 – 2018", "en")], "doc_id bigint, role_ix int, title string, dates string, doc_lang string")
    lines = spark.createDataFrame([(1, 0, "Opened the Dubai site")], "doc_id bigint, line_ix int, text string")
    assert [r["hit"] for r in li.l6_titles_never_held(docs, roles).collect()] == ["ceo"]
    alias = spark.createDataFrame([("dubai", "UAE", None), ("qatar", "QA", None), ("germany", "DE", None), ("gcc", None, "GCC")], "place string, country string, meta string")
    members = spark.createDataFrame([("GCC", "UAE"), ("GCC", "QA")], "meta string, country string")
    assert sorted(r["hit"] for r in li.l6_orphan_places(docs, lines, alias, members, ["dubai", "qatar", "germany", "gcc"]).collect()) == ["germany", "qatar"]
    assert ids(li.l3_references(docs)) == ["REF-01", "REF-03"]
    assert [r["path"] for r in li.l2_date_words(docs, roles).orderBy("path").collect()] == ["langs", "roles.0.dates"]


def test_acknowledged_instances_leave_the_score(spark):
    found = spark.createDataFrame([(1, "HL-05", "med", "headline", "dynamic"), (1, "SUM-04", "high", "summary", "focus for"), (1, "EXP-06", "low", "roles.0", "-")], "doc_id bigint, check_id string, sev string, path string, hit string")
    acks = found.where("check_id <> 'EXP-06'").select(li.instance_key().alias("key"))
    live = li.live_instances(found, acks, F.lit(False))
    assert ids(live) == ["SUM-04"]  # a med one may be checked, a high one may not; a deferred one waits
    s = li.scores(li.penalties(live)).first()
    assert (s["raw_score"], s["score"], s["verdict"]) == (85, 59, "not ready")


def test_sql_functions(spark):
    from dossierflow.functions.sql import register
    register(spark)
    r = spark.sql("SELECT df_norm('Café—x Y') a, df_stem('working') b, df_has_word('the big plan', 'Big') c, df_votes_de('und der Hund') d, size(df_words('a b')) e, df_sentence_count('One. Two! three') f").first()
    assert tuple(r) == ("café x y", "work", True, 2, 2, 2)


def test_custom_tagger_hook(spark):
    from dossierflow.operators.lexicon import custom_tags
    out = custom_tags(texts(spark, ["a b", "c"]), "v", lambda s: s.str.split(" ")).orderBy("i").collect()
    assert [r["tags"] for r in out] == [["a", "b"], ["c"]]
