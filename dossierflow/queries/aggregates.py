"""Aggregations."""
from pyspark.sql import functions as F

from dossierflow.catalog import query
from dossierflow.functions import dates as dt
from dossierflow.functions import text as tx
from dossierflow.functions.text import q_has_term, q_str
from dossierflow.operators import aggregates as ag
from dossierflow.operators import lexicon as lx
from dossierflow.operators import matching as mt
from dossierflow.operators.scale import join_small, worked_out_once
from dossierflow.queries.joins import Q_KINDS, lex
from dossierflow.queries.listings import Q_MUST, must_candidates
from dossierflow.tables import Q_LEXICON, Q_PARAGRAPHS

Q_PROFILE = "doc_id % (SELECT count(*) FROM benchmark)"


def profile_of(t):
    """The benchmark item that a document is held against: all items take part in turn."""
    return F.col("doc_id") % t.benchmark.select(F.count(F.lit(1))).scalar()


@query("e1_phrase_counts", rf"""SELECT lang, phrase, count(*) AS n FROM (SELECT lang, {tx.q_squeeze('p')} AS phrase FROM (SELECT lang, unnest(regexp_extract_all(text, {q_str(ag.TITLE_PHRASE)}, 1)) AS p FROM documents)) WHERE length(phrase) BETWEEN 6 AND 60 GROUP BY ALL""")
def _(t):
    return ag.phrase_counts(t.documents, ["lang"], "text")


@query("e2_vocab_counts", f"WITH {Q_LEXICON} SELECT lang, concept, count(*) AS n FROM (SELECT lang, unnest({tx.q_words('text')}) AS concept FROM documents) JOIN bench_lex USING (concept) GROUP BY ALL")
def _(t):
    return lx.concept_occurrences(t.documents, ["lang"], "text", lex(t)).groupBy("lang", "concept").agg(F.count(F.lit(1)).alias("n"))


LADDER = [("executive", ["thou"]), ("director", ["shed", "thion"]), ("manager", ["und", "les"])]
KIND = "CASE WHEN length(term) >= 9 THEN 'titles' WHEN length(term) = 8 THEN 'places' WHEN length(term) <= 5 THEN 'skills' END"


@query("e3_text_signature", f"""WITH {Q_LEXICON}, h AS (SELECT doc_id, concept AS term, count(*) AS n_hits, min(pos) AS first_pos FROM (
  SELECT doc_id, w AS concept, pos FROM (SELECT doc_id, {tx.q_words('text')} AS ws FROM documents) d, unnest(d.ws) WITH ORDINALITY AS u(w, pos)) JOIN bench_lex USING (concept) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY n_hits DESC, first_pos, term) AS rk FROM (SELECT *, {KIND} AS kind FROM h))
SELECT d.doc_id, CASE WHEN {q_has_term('text', ['thou'])} THEN 'executive' WHEN {q_has_term('text', ['shed', 'thion'])} THEN 'director' WHEN {q_has_term('text', ['und', 'les'])} THEN 'manager' ELSE 'professional' END AS level,
  coalesce(titles, '') AS titles, coalesce(places, '') AS places, coalesce(skills, '') AS skills
FROM documents d LEFT JOIN (SELECT doc_id, string_agg(term, '|' ORDER BY rk) FILTER (WHERE kind = 'titles' AND rk <= 6) AS titles, string_agg(term, '|' ORDER BY rk) FILTER (WHERE kind = 'places' AND rk <= 5) AS places,
  string_agg(term, '|' ORDER BY rk) FILTER (WHERE kind = 'skills' AND rk <= 14) AS skills FROM r GROUP BY 1) s ON d.doc_id = s.doc_id""")
def _(t):
    hits = (lx.concept_match(t.documents, ["doc_id"], "text", lex(t)).withColumnRenamed("concept", "term")
            .withColumn("kind", F.expr(KIND)).where("kind IS NOT NULL"))
    return ag.text_signature(t.documents, "doc_id", ag.first_level("text", LADDER, "professional"), hits, {"titles": 6, "places": 5, "skills": 14})


@query("e6_figure_coverage", f"""WITH {Q_PARAGRAPHS}, a AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE {tx.q_has_figure('line')}) AS n_figures FROM paragraphs GROUP BY 1)
SELECT *, ((200 * n_figures + n_lines) // (2 * n_lines))::INT AS pct, n_figures * 100 < 40 * n_lines AS few FROM a""")
def _(t):
    return ag.figure_coverage(t.paragraphs, "doc_id", "line")


@query("e7_opener_repetition", f"WITH {Q_PARAGRAPHS} SELECT doc_id, opener, count(*) AS n_lines FROM (SELECT doc_id, {tx.q_letter_words('line')}[1] AS opener FROM paragraphs) WHERE opener IS NOT NULL GROUP BY ALL HAVING count(*) >= 3")
def _(t):
    return ag.opener_repetition(t.paragraphs, "doc_id", "line")


# ---- postings (documents) against profiles (benchmark items), one profile per posting


def must_with_profile(t):
    return lx.must_have_top(must_candidates(t), "doc_id").select("doc_id", profile_of(t).alias("item_id"), "concept", "must", "rk")


def profile_lines(t):
    return t.benchmark.select("item_id", F.posexplode(tx.lines("text")).alias("line_ix", "line"))


def profile_tokens(t):
    return profile_lines(t).select("item_id", "line_ix", F.explode(tx.words("line")).alias("token"))


def swap_rows(t, must):
    return mt.propose_swaps(must, profile_lines(t), t.lexicon.select("concept", F.left("concept", F.lit(5)).alias("g")), "doc_id", "item_id")


def report_rows(t):
    must = worked_out_once(must_with_profile(t), "doc_id", "concept", 1)  # at most three rows of a posting; report and swaps read them
    return mt.keyword_report(must, profile_tokens(t), swap_rows(t, must), "doc_id", "item_id")


Q_SWAPS = Q_MUST + rf""", must AS (SELECT doc_id, {Q_PROFILE} AS item_id, concept, must, rk::INT AS rk FROM ranked WHERE rk <= 3),
pl AS (SELECT item_id, (ix - 1)::INT AS line_ix, line FROM benchmark, unnest({tx.q_lines('text')}) WITH ORDINALITY AS u(line, ix)),
pt AS (SELECT item_id, line_ix, line, ws, (p - 1)::INT AS pos, w AS synonym, lower(w) AS token FROM (SELECT *, list_filter(regexp_split_to_array(line, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ws FROM pl) x, unnest(x.ws) WITH ORDINALITY AS v(w, p)),
need AS (SELECT * FROM must m WHERE NOT EXISTS (SELECT 1 FROM pt WHERE pt.item_id = m.item_id AND pt.token = m.concept)),
sw0 AS (SELECT n.doc_id, n.item_id, n.concept, line_ix, pos, synonym, CASE WHEN regexp_matches(synonym, '^\p{{Lu}}') THEN upper(left(n.concept, 1)) || substring(n.concept, 2) ELSE n.concept END AS to_,
    md5(n.concept || '|' || n.item_id::VARCHAR || '|' || line || '|' || pos::VARCHAR || '|' || synonym) AS swap_id, CASE WHEN pos > 0 THEN lower(ws[pos]) END AS prev
  FROM need n JOIN bench_lex f ON left(f.concept, 5) = left(n.concept, 5) AND f.concept <> n.concept JOIN pt ON pt.item_id = n.item_id AND pt.token = f.concept),
swaps AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, concept ORDER BY line_ix, pos, synonym) AS rn FROM sw0
  WHERE NOT (coalesce(prev, '') = 'a' AND regexp_matches(concept, '^[aeiou]')) AND NOT (coalesce(prev, '') = 'an' AND NOT regexp_matches(concept, '^[aeiou]'))) WHERE rn = 1)"""
Q_REPORT = Q_SWAPS + f""", ex AS (SELECT item_id, token, min(line_ix) AS ix FROM pt GROUP BY ALL), st AS (SELECT item_id, {tx.q_stem('token')} AS s, min(line_ix) AS ix FROM pt GROUP BY ALL),
report AS (SELECT m.doc_id, m.item_id, m.concept, m.must, m.rk, CASE WHEN ex.ix IS NOT NULL THEN 'in-cv' WHEN s.line_ix IS NOT NULL THEN 'swap' WHEN st.ix IS NOT NULL THEN 'other-words' ELSE 'gap' END AS state, coalesce(ex.ix, s.line_ix, st.ix) AS evidence_ix
  FROM must m LEFT JOIN ex ON ex.item_id = m.item_id AND ex.token = m.concept LEFT JOIN swaps s ON s.doc_id = m.doc_id AND s.concept = m.concept LEFT JOIN st ON st.item_id = m.item_id AND st.s = {tx.q_stem('m.concept')})"""


@query("h8_propose_swaps", Q_SWAPS + ' SELECT doc_id, item_id, concept, line_ix, pos, synonym, to_ AS "to", swap_id FROM swaps')
def _(t):
    return swap_rows(t, must_with_profile(t))


@query("h9_keyword_report", Q_REPORT + " SELECT * FROM report")
def _(t):
    return report_rows(t)


@query("e12_keyword_strength", Q_REPORT + """, a AS (SELECT *, length(concept) % 2 = 0 AS approved FROM report)
SELECT doc_id, count(*)::INT AS n_of, count(*) FILTER (WHERE state = 'in-cv' OR (state = 'swap' AND approved))::INT AS n_have, count(*) FILTER (WHERE state = 'swap' AND NOT approved)::INT AS n_offered,
  count(*) FILTER (WHERE state = 'other-words')::INT AS n_other, count(*) FILTER (WHERE state = 'gap')::INT AS n_gap,
  ((200 * count(*) FILTER (WHERE state = 'in-cv' OR (state = 'swap' AND approved)) + count(*)) // (2 * count(*)))::INT AS strength FROM a GROUP BY 1""")
def _(t):
    return ag.keyword_strength(report_rows(t).withColumn("approved", F.length("concept") % 2 == 0), "doc_id")


@query("e13_fit_score", Q_MUST + rf""", p AS (SELECT DISTINCT item_id, unnest({tx.q_words('text')}) AS w FROM benchmark),
s AS (SELECT doc_id, CASE WHEN must THEN 'must' ELSE 'nice' END AS strength, length(concept) >= 9 AS own, CASE WHEN ends_with(concept, 'wh') AND must THEN 'blocker' WHEN w IS NOT NULL THEN 'proven' WHEN length(concept) = 4 THEN 'unchecked' ELSE 'unproven' END AS state
  FROM cand LEFT JOIN p ON p.item_id = {Q_PROFILE} AND p.w = concept),
a AS (SELECT doc_id, sum(CASE WHEN state IN ('proven', 'unproven') THEN CASE WHEN strength = 'nice' THEN 1 WHEN own THEN 3 ELSE 2 END ELSE 0 END)::INT AS total, sum(CASE WHEN state = 'proven' THEN CASE WHEN strength = 'nice' THEN 1 WHEN own THEN 3 ELSE 2 END ELSE 0 END)::INT AS got,
  bool_or(state = 'blocker') AS blocked, bool_or(state = 'unproven' AND strength = 'must') AS must_open FROM s GROUP BY 1),
b AS (SELECT *, CASE WHEN total > 0 THEN ((200 * got + total) // (2 * total))::INT END AS score FROM a)
SELECT doc_id, score, CASE WHEN blocked OR coalesce(score < 40, false) THEN 'skip' WHEN score IS NULL OR must_open THEN 'gap' ELSE 'apply' END AS verdict FROM b""")
def _(t):
    """Every lexicon concept of a document is a requirement; the last line's are musts; the profile proves what it prints."""
    req = must_candidates(t).select("doc_id", profile_of(t).alias("item_id"), "concept", "must")
    have = profile_tokens(t).select("item_id", F.col("token").alias("concept")).distinct().withColumn("have", F.lit(True))
    state = (F.when(F.col("concept").endswith("wh") & F.col("must"), "blocker").when(F.col("have"), "proven")
             .when(F.length("concept") == 4, "unchecked").otherwise("unproven"))
    states = join_small(req, have, ["item_id", "concept"], "left").select(
        "doc_id", F.when(F.col("must"), "must").otherwise("nice").alias("strength"), state.alias("state"), (F.length("concept") >= 9).alias("own_field"))
    return ag.fit_score(states, "doc_id")


@query("e14_readiness_options", f"""WITH {Q_LEXICON}, needs AS (SELECT left(concept, 1) AS option, concept FROM bench_lex WHERE length(concept) >= 8), sz AS (SELECT option, count(*) AS n FROM needs GROUP BY 1),
h AS (SELECT doc_id, option, count(*) AS have FROM (SELECT DISTINCT doc_id, unnest({tx.q_words('text')}) AS concept FROM documents) JOIN needs USING (concept) GROUP BY ALL),
f AS (SELECT doc_id, option, ((200 * have + n) // (2 * n))::INT AS fit, (n - have)::INT AS gaps FROM h JOIN sz USING (option))
SELECT doc_id, option, fit, gaps FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY fit DESC, gaps, option) AS rk FROM f) WHERE rk = 1""")
def _(t):
    needs = t.lexicon.where(F.length("concept") >= 8).select(F.left("concept", F.lit(1)).alias("option"), F.col("concept").alias("flag"))
    flags = t.documents.select("doc_id", F.explode(F.array_distinct(tx.words("text"))).alias("flag"))
    return ag.readiness_options(flags, needs, "doc_id")


Q_LINE_LANG = f"""line_lang AS (SELECT *, {tx.q_lang_from_votes()} AS l FROM (SELECT doc_id, lang, source, line_ix, {', '.join(f"{tx.q_votes('line', k)} AS v_{k}" for k in tx.STOPWORDS)} FROM paragraphs))"""


@query("e16_language_share", f"""WITH {Q_PARAGRAPHS}, {Q_LINE_LANG}, a AS (SELECT doc_id, count(*) AS n_known, count(*) FILTER (WHERE l = lang) AS n_target FROM line_lang WHERE l <> 'unknown' GROUP BY 1)
SELECT *, n_known >= 3 AND n_target * 2 < n_known AS off FROM a""")
def _(t):
    return ag.language_share(t.paragraphs, ["doc_id"], "line", "lang")


@query("e17_estimate_length", f"SELECT doc_id, w::INT AS n_words, CASE WHEN w > CASE WHEN doc_id % 12 >= 8 THEN 950 ELSE 550 END THEN 'long' ELSE 'fits' END AS verdict FROM (SELECT doc_id, {tx.q_word_count('text')} AS w FROM documents)")
def _(t):
    """Years of experience stand in as ``doc_id % 12``."""
    n = tx.word_count("text")
    return t.documents.select("doc_id", n.alias("n_words")).withColumn("verdict", F.when(
        F.col("n_words") > F.when(F.col("doc_id") % 12 >= 8, 950).otherwise(550), "long").otherwise("fits")).select("doc_id", "n_words", "verdict")


@query("e18_style_majority", """WITH f AS (SELECT o_custkey, CASE o_orderkey % 4 WHEN 0 THEN 'MM/YYYY' WHEN 1 THEN 'Mon YYYY' WHEN 2 THEN 'Mon YYYY' ELSE 'YYYY' END AS fmt, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_custkey, arg_min(fmt, {'n': -n, 'f': fmt}) AS majority, (sum(n) - max(n))::BIGINT AS n_minority FROM f GROUP BY 1 HAVING sum(n) > max(n)""")
def _(t):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    printed = F.when(k == 0, F.date_format(d, "MM/yyyy")).when(k == 3, F.date_format(d, "yyyy")).otherwise(F.date_format(d, "MMM yyyy"))
    return ag.style_majority(t.orders.select("o_custkey", dt.parse_side(printed)["fmt"].alias("fmt")), "o_custkey", "fmt")


SCOPE = ("staff", "team", "division", "countries", "sites", "the", "und", "les")


@query("e22_proof_points", f"WITH {Q_PARAGRAPHS} SELECT doc_id, count(*) AS n_proof FROM paragraphs WHERE {tx.q_has_figure('line')} OR {q_has_term('line', SCOPE)} GROUP BY 1")
def _(t):
    return (t.paragraphs.where(tx.has_figure("line") | tx.has_term("line", SCOPE)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_proof")))


@query("e23_language_readiness", f"""WITH {Q_PARAGRAPHS}, {Q_LINE_LANG}, a AS (SELECT source, unnest(['de', 'en', 'es', 'fr']) AS target, l FROM line_lang WHERE l <> 'unknown'),
b AS (SELECT source, target, count(*) FILTER (WHERE l = target) AS n_target, count(*) AS n FROM a GROUP BY ALL)
SELECT source, target, n_target, n_target * 2 >= n AS ready FROM b""")
def _(t):
    """Ready when at least half of the lines whose language is known are in the language."""
    known = t.paragraphs.withColumn("l", tx.lang_of("line")).where("l <> 'unknown'").groupBy("source", "l").agg(F.count(F.lit(1)).alias("n"))
    spread = known.select("source", "l", "n", F.explode(F.array(*[F.lit(k) for k in sorted(tx.STOPWORDS)])).alias("target"))
    agg = spread.groupBy("source", "target").agg(F.sum(F.when(F.col("l") == F.col("target"), F.col("n")).otherwise(0)).alias("n_target"), F.sum("n").alias("_n"))
    return agg.select("source", "target", "n_target", (F.col("n_target") * 2 >= F.col("_n")).alias("ready"))
