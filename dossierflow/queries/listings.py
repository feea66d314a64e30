"""Listing feeds, merges, ranks and picks."""
from pyspark.sql import functions as F

from dossierflow.catalog import query
from dossierflow.functions import contacts as ct
from dossierflow.functions import html as hx
from dossierflow.functions import text as tx
from dossierflow.functions import urls as ux
from dossierflow.operators import lexicon as lx
from dossierflow.operators import listings as ls
from dossierflow.operators import pages as pg
from dossierflow.operators.scale import join_small, keep_first
from dossierflow.tables import Q_LEXICON

Q_TITLE = f"{tx.q_lines('text')}[1]"
ANY_HOST = r"(?!)"


def _titled(t):
    """Documents as listings: the first line is the title."""
    return t.documents.withColumn("title", F.coalesce(F.try_element_at(tx.lines("text"), F.lit(1)), F.lit("")))


def _profile(t):
    """Profile terms from the lexicon: long words are roles and steps, short ones skills."""
    return t.lexicon.select(F.col("concept").alias("term"), F.when(F.length("concept") >= 10, "role")
                            .when(F.length("concept") == 9, "step").when(F.length("concept") <= 5, "skill").alias("kind")).where("kind IS NOT NULL")


@query("f1_keep_first", """SELECT doc_id, source, key FROM (SELECT doc_id, source, md5(text) AS key, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def _(t):
    df = t.documents.select("doc_id", "source", F.md5("text").alias("key"))
    return keep_first(df, ["key"], [F.col("doc_id")])


@query("f2_priority_merge", """SELECT doc_id, priority, key FROM (SELECT doc_id, (doc_id % 3)::INT AS priority, md5(text) AS key,
  row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id % 3, doc_id) AS rn FROM documents) WHERE rn = 1""")
def _(t):
    df = t.documents.select("doc_id", F.md5("text").alias("key"))
    return ls.priority_merge([df.where(F.col("doc_id") % 3 == i) for i in range(3)], "key", "doc_id")


Q_MUST = f"""WITH {Q_LEXICON},
tok AS (SELECT doc_id, line_ix, n_lines, w AS concept, (pos - 1)::INT AS pos FROM (
    SELECT doc_id, (li - 1)::INT AS line_ix, len(ls) AS n_lines, {tx.q_words('line')} AS ws FROM (SELECT doc_id, {tx.q_lines('text')} AS ls FROM documents) d, unnest(d.ls) WITH ORDINALITY AS u(line, li)) x,
  unnest(x.ws) WITH ORDINALITY AS v(w, pos)),
cand AS (SELECT doc_id, concept, count(*) AS n_hits, bool_or(line_ix = 0) AS in_title, bool_or(line_ix > 0 AND line_ix = n_lines - 1) AS must, min(line_ix::BIGINT * 4294967296 + pos) AS first_pos
  FROM tok JOIN bench_lex USING (concept) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY must DESC, n_hits DESC, in_title DESC, first_pos, concept) AS rk FROM cand)"""


def must_candidates(t):
    """Lexicon concepts per document: title is the first line, the last line states what is demanded. ``first_pos`` holds the line in its
    upper and the place in the line in its lower 32 bits."""
    ls = t.documents.select("doc_id", tx.lines("text").alias("ls"))
    rows = ls.select("doc_id", F.size("ls").alias("n_lines"), F.posexplode(tx.as_made("ls")).alias("line_ix", "line"))
    occ = lx.concept_occurrences(rows, ["doc_id", "n_lines", "line_ix"], "line", t.lexicon.select("concept", F.col("concept").alias("form")))
    return occ.groupBy("doc_id", "concept").agg(
        F.count(F.lit(1)).alias("n_hits"), F.bool_or(F.col("line_ix") == 0).alias("in_title"),
        F.bool_or((F.col("line_ix") > 0) & (F.col("line_ix") == F.col("n_lines") - 1)).alias("must"),
        F.min(F.shiftleft(F.col("line_ix").cast("long"), 32) + F.col("pos")).alias("first_pos")).withColumn("lex_order", F.col("concept"))


@query("f3_must_have_top3", Q_MUST + " SELECT doc_id, concept, must, n_hits, in_title, first_pos, rk::INT AS rk FROM ranked WHERE rk <= 3")
def _(t):
    return lx.must_have_top(must_candidates(t), "doc_id").drop("lex_order")


@query("d3_concept_match", f"""WITH {Q_LEXICON}, tok AS (SELECT doc_id, w AS concept, (pos - 1)::INT AS pos FROM (SELECT doc_id, {tx.q_words('text')} AS ws FROM documents) d, unnest(d.ws) WITH ORDINALITY AS u(w, pos))
SELECT doc_id, concept, count(*) AS n_hits, min(pos)::INT AS first_pos FROM tok JOIN bench_lex USING (concept) GROUP BY ALL""")
def _(t):
    return lx.concept_match(t.documents, ["doc_id"], "text", t.lexicon.select("concept", F.col("concept").alias("form")))


def _runs(t):
    """Days on which any user has an event: the days a collection ran."""
    return t.events.select(F.to_date("ts").alias("day")).distinct()


@query("f9_carry_forward", """WITH per_day AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL),
cells AS (SELECT g.user_id, g.day, coalesce(n, 0) AS n FROM (SELECT user_id, unnest(range((SELECT min(ts)::DATE FROM events), (SELECT max(ts)::DATE + 1 FROM events), INTERVAL 1 DAY))::DATE AS day FROM (SELECT DISTINCT user_id FROM events)) g LEFT JOIN per_day p ON g.user_id = p.user_id AND g.day = p.day),
w AS (SELECT *, last_value(CASE WHEN n > 0 THEN n END IGNORE NULLS) OVER o AS ln, last_value(CASE WHEN n > 0 THEN day END IGNORE NULLS) OVER o AS ld FROM cells
  WINDOW o AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT w.user_id, w.day, e.event_id, n = 0 AS stale, CASE WHEN n = 0 THEN ld END AS stale_since FROM w JOIN events e ON e.user_id = w.user_id AND e.ts::DATE = CASE WHEN n = 0 THEN ld ELSE w.day END""")
def _(t):
    """Events as listings, users as sources: each day's listings, its own or carried."""
    return ls.carry_rows(_event_rows(t), _runs(t), "user_id", "day")


def _event_rows(t):
    return t.events.select("user_id", F.to_date("ts").alias("day"), "event_id")


@query("f10_round_robin", """SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC)::INT AS turn, min(doc_id) OVER (PARTITION BY source) AS source_order FROM documents""")
def _(t):
    return ls.round_robin(t.documents.select("doc_id", "source"), "source", F.col("doc_id").desc(), -F.floor(F.col("doc_id") / 4096), "doc_id")


@query("g1_rank_listings", f"""WITH {Q_LEXICON}, terms AS (SELECT concept AS term, CASE WHEN length(concept) >= 10 THEN 'role' WHEN length(concept) = 9 THEN 'step' WHEN length(concept) <= 5 THEN 'skill' END AS kind FROM bench_lex),
l AS (SELECT doc_id, lang, source, {Q_TITLE} AS title, list_distinct({tx.q_words(Q_TITLE)}) AS tw, list_distinct({tx.q_words('text')}) AS aw FROM documents),
hits AS (SELECT doc_id, sum((kind = 'role' AND list_contains(tw, term))::INT) AS r, sum((kind = 'step' AND list_contains(tw, term))::INT) AS st, sum((kind = 'skill')::INT) AS sk
  FROM (SELECT doc_id, tw, unnest(aw) AS term FROM l) JOIN terms USING (term) WHERE kind IS NOT NULL GROUP BY doc_id)
SELECT doc_id, coalesce(title, '') AS title, least(99, 68 + 14 * CASE WHEN r > 0 THEN r ELSE st END + 4 * sk + CASE WHEN source = 'src3' THEN 10 WHEN lang = 'en' THEN 6 ELSE 0 END - CASE WHEN r = 0 AND st > 0 THEN 3 ELSE 0 END)::INT AS score,
  CASE WHEN r = 0 AND st > 0 THEN 'step' ELSE 'level' END AS track
FROM hits JOIN l USING (doc_id) WHERE r > 0 OR st > 0 OR sk >= 2 ORDER BY score DESC, title, doc_id LIMIT 45""")
def _(t):
    listings = _titled(t)
    hits = ls.profile_hits(listings, "doc_id", "title", "text", _profile(t))
    return ls.rank_listings(listings.select("doc_id", "title", "source", "lang"), hits, "doc_id",
                            F.col("source") == "src3", F.col("lang") == "en").select("doc_id", "title", "score", "track")


_SKILLS = ["thing", "tion", "ment", "lich"]


def _web_sql():
    title = hx.q_first_tag("html", "h1")
    hay = "lower(title || ' ' || content)"
    sk = " + ".join(f"4 * contains({hay}, '{s}')::INT" for s in _SKILLS)
    arms = ", ".join(f"CASE WHEN contains({hay}, '{s}') THEN '{s}' END" for s in _SKILLS)
    return f"""SELECT page_id, least(99, greatest(40, 45 + CASE WHEN role IS NOT NULL THEN 32 ELSE 0 END + {sk} + CASE WHEN contains({hay}, 'stadt') THEN 10 ELSE 0 END
  + CASE WHEN regexp_matches(url, 'example\\.org') THEN 8 ELSE 0 END - CASE WHEN regexp_matches(title, '(?:^|[^0-9])20(?:1[0-9]|2[0-4])(?:$|[^0-9])') THEN 12 ELSE 0 END))::INT AS score,
  array_to_string(list_filter([role, {arms}, CASE WHEN contains({hay}, 'stadt') THEN 'stadt' END], lambda x: x IS NOT NULL), ',') AS why
FROM (SELECT page_id, url, coalesce({title}, '') || ' ' || (2010 + page_id % 20)::VARCHAR AS title, {hx.q_to_text('html')} AS content, CASE WHEN contains(coalesce({title}, ''), 'the') THEN 'the' END AS role FROM pages)"""


@query("g2_score_web_hits", _web_sql())
def _(t):
    head = F.coalesce(hx.first_tag("html", "h1"), F.lit(""))
    hits = t.pages.select("page_id", "url", F.concat_ws(" ", head, (2010 + F.col("page_id") % 20).cast("string")).alias("title"),
                          hx.to_text("html").alias("content"), F.when(F.contains(head, F.lit("the")), "the").alias("role"))
    return ls.score_web_hits(hits, F.col("role"), _SKILLS, "stadt", r"example\.org").select("page_id", "score", F.array_join("why", ",").alias("why"))


@query("g3_per_source_cap", "SELECT doc_id, source, rk::INT AS rk FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rk FROM documents) WHERE rk <= 35")
def _(t):
    return ls.per_source_cap(t.documents.select("doc_id", "source"), "source", [F.col("doc_id")], 35)


@query("g4_rank_emails", f"""SELECT doc_id, email, max({ct.q_email_score('email', "'mail2.example.com'")}) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY max({ct.q_email_score('email', "'mail2.example.com'")}) DESC, email)::INT AS rk
FROM (SELECT doc_id, unnest({ct.q_emails("text || ' hr@' || source || '.test info@' || source || '.test x@gmail.com'")}) AS email FROM documents) WHERE {ct.q_usable('email', ANY_HOST.replace('(?!)', '^$'))} GROUP BY doc_id, email""")
def _(t):
    body = F.concat("text", F.lit(" hr@"), "source", F.lit(".test info@"), "source", F.lit(".test x@gmail.com"))
    return ls.rank_emails(t.documents.select("doc_id", body.alias("text")), ["doc_id"], "text", F.lit("mail2.example.com"), "^$")


@query("g5_resolve_contact", f"""WITH l AS (SELECT doc_id, source, text, CASE WHEN doc_id % 4 = 0 THEN 'HR@Stored.test' ELSE '' END AS to_address, CASE WHEN doc_id % 8 = 0 THEN 'Corporate HR Mailbox (x)' ELSE '' END AS via FROM documents),
p AS (SELECT doc_id, email FROM (SELECT doc_id, email, row_number() OVER (PARTITION BY doc_id ORDER BY {ct.q_email_score('email', "''")} DESC, email) AS rk FROM (SELECT doc_id, unnest({ct.q_emails('text')}) AS email FROM l) WHERE {ct.q_usable('email', '^$')}) WHERE rk = 1)
SELECT doc_id, coalesce(email, CASE WHEN to_address <> '' AND via = '' THEN 'hr@stored.test' END, CASE WHEN source IN ('src1', 'src2') THEN 'desk@' || source || '.test' END, '') AS email,
  CASE WHEN email IS NOT NULL THEN 'Extracted Directly from Job Description' WHEN to_address <> '' AND via = '' THEN 'Verified Listing Email' WHEN source IN ('src1', 'src2') THEN 'Desk of ' || source ELSE 'Apply via Employer Portal / ATS' END AS via
FROM l LEFT JOIN p USING (doc_id)""")
def _(t):
    listings = t.documents.select("doc_id", "source", "text", F.when(F.col("doc_id") % 4 == 0, "HR@Stored.test").otherwise("").alias("to_address"),
                                  F.when(F.col("doc_id") % 8 == 0, "Corporate HR Mailbox (x)").otherwise("").alias("via"))
    desks = t.documents.where("source IN ('src1', 'src2')").select("source").distinct().select(
        "source", F.concat(F.lit("desk@"), "source", F.lit(".test")).alias("desk_email"), F.concat(F.lit("Desk of "), "source").alias("desk_via"))
    return ls.resolve_contact(listings, "doc_id", "text", desks, "^$")


@query("g6_top_evidence", """SELECT conv_id, turn, rk::INT AS rk FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rk FROM conversations) WHERE rk <= 3""")
def _(t):
    return ls.top_k(t.conversations.select("conv_id", "turn", F.length("text").alias("n")), ["conv_id"], [F.col("n").desc(), F.col("turn")], 3).drop("n")


@query("g7_visible_with_reserve", """WITH d AS (SELECT doc_id, source, coalesce(quality, 0) = 1 AND coalesce(toxic, 0) = 1 AS on_ FROM documents LEFT JOIN labels USING (doc_id)),
r AS (SELECT *, count(*) FILTER (WHERE on_) OVER (PARTITION BY source) AS held, row_number() OVER (PARTITION BY source, on_ ORDER BY doc_id) AS rk FROM d)
SELECT doc_id, source FROM r WHERE on_ OR rk <= greatest(0, 6 - held)""")
def _(t):
    d = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    on = (F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 1)
    return ls.visible_with_reserve(d, "source", on, F.col("doc_id")).select("doc_id", "source")


@query("g9_hydrate_top", f"""SELECT p.page_id, {hx.q_to_text('p.html')} AS detail FROM (SELECT page_id, length({hx.q_to_text('html')}) AS n FROM pages WHERE length(url) < 45 ORDER BY n DESC, page_id LIMIT 5) r JOIN pages p ON r.page_id = p.page_id""")
def _(t):
    ranked = t.pages.select("page_id", "url", F.length(hx.to_text("html")).alias("n"))
    details = t.pages.select("page_id", "html")
    return ls.hydrate_top(ranked, details, "page_id", F.length("url") < 45, [F.col("n").desc(), F.col("page_id")]).select("page_id", hx.to_text("html").alias("detail"))


@query("e4_source_health", """WITH f AS (SELECT source, count(*) AS n_found, bool_or(n_chars < 60) AS failed FROM documents GROUP BY 1),
m AS (SELECT source, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 1 GROUP BY 1)
SELECT coalesce(f.source, m.source) AS source, coalesce(n_found, 0)::BIGINT AS n_found, coalesce(n, 0) AS n_matched, CASE WHEN coalesce(n, 0) > 0 THEN 'ok' WHEN coalesce(failed, false) THEN 'error' ELSE 'empty' END AS status FROM f FULL JOIN m ON f.source = m.source""")
def _(t):
    log = t.documents.select("source", F.lit(1).alias("n_found"), (F.col("n_chars") < 60).alias("failed"))
    kept = t.documents.join(t.labels.where("quality = 1 AND toxic = 1"), "doc_id", "left_semi").select("source")
    return ls.source_health(log, kept)


@query("e5_funnel_counts", """SELECT source, count(*) AS raw, count(DISTINCT md5(text)) AS uniq, count(*) FILTER (WHERE n_chars >= 400) AS ranked, count(*) FILTER (WHERE n_chars >= 400 AND lang = 'en') AS level_track,
  count(*) FILTER (WHERE n_chars >= 400 AND lang <> 'en') AS step_track FROM documents GROUP BY source""")
def _(t):
    """Distinct counts in two steps: per (source, key) first, so a hot source spreads over many tasks."""
    rows = t.documents.select("source", F.md5("text").alias("key"), "n_chars", "lang")
    return ls.funnel_counts(rows, "source", "key", F.col("n_chars") >= 400, F.col("lang") == "en")


@query("a1_flatten_feed", "SELECT source, doc_id, 'https://' || source || '.test/' || doc_id::VARCHAR AS url FROM documents WHERE n_chars % 10 <> 0 AND lang <> 'es'")
def _(t):
    """Documents nested as a feed per (source, slice of 64 ids), then flattened; slices keep a hot source in many rows."""
    job = F.struct("doc_id", F.when(F.col("n_chars") % 10 == 0, "search").otherwise("page").alias("kind"), F.concat(
        F.when(F.col("lang") == "es", "ftp://").otherwise("https://"), "source", F.lit(".test/"), F.col("doc_id").cast("string")).alias("url"))
    feed = (t.documents.groupBy("source", F.floor(F.col("doc_id") / 64).alias("slice")).agg(F.collect_list(job).alias("jobs"))
            .select(F.array(F.struct(F.col("source").alias("id"), F.lit(True).alias("ok"), "jobs")).alias("sources")))
    return ls.flatten_feed(feed).select("source", "doc_id", "url")
