"""Document lint: rule families, penalties, scores, screening."""
from pyspark.sql import functions as F

from dossierflow.catalog import ORACLES, query
from dossierflow.functions import contacts as ct
from dossierflow.functions import dates as dt
from dossierflow.functions import text as tx
from dossierflow.functions.text import q_has_term, q_list, q_str
from dossierflow.operators import intervals as iv
from dossierflow.operators.scale import join_small, worked_out_once
from dossierflow.plans import catalogue as cat
from dossierflow.plans import lint as li
from dossierflow.queries.aggregates import Q_REPORT, report_rows
from dossierflow.queries.intervals import Q_ISLANDS, TODAY, _ranked, Q_RECENCY
from dossierflow.queries.joins import Q_NEAR, _q_figures, q_near
from dossierflow.tables import Q_ORDER_ROLES, Q_PARAGRAPHS

# Term lists made of words that occur in the given documents.
WORDS = {"HL-03": ("thou", "les"), "HL-05": ("tion", "und"), "SUM-03": ("with", "avec", "mit", "para"), "SUM-04": ("shed",), "SUM-10": ("that", "je", "la"),
         "SKL-02": ("thererthou",), "SKL-04": ("thtionthou",), "MKT-01": ("from", "this"), "BUL-04": ("the", "der", "le", "el"), "BUL-05": ("is", "est", "ist"), "DOC-05": ("auf", "sich")}
TITLES = ("tion", "sur", "auf", "con")
COMPANY = ("for", "pour")
DIAL = {"dial": {"+1(1": "A", "+1": "B"}, "place_country": {"src1": "A", "src2": "B", "src3": "C", "src14": "A"}}


def profile(t):
    """Documents as profiles: first sentence is the headline, first line the summary, the other lines the bullets."""
    ls = t.documents.select("doc_id", "lang", "source", "text", tx.lines("text").alias("ls"), tx.sentences("text").alias("ss"))
    k = F.col("doc_id")
    return ls.select(
        "doc_id", F.col("lang").alias("doc_lang"), F.when(k % 3 == 0, "gcc").when(k % 3 == 1, "dach").otherwise("uk").alias("market"),
        F.col("source").alias("name"), F.coalesce(F.get(ct.emails("text"), F.lit(0)), F.lit("")).alias("email"), F.coalesce(F.get(ct.phones("text"), F.lit(0)), F.lit("")).alias("phone"),
        F.when(k % 5 == 0, "").otherwise(F.col("source")).alias("city"), F.when(k % 2 == 0, "").otherwise("permit").alias("work_rights"),
        F.coalesce(F.get("ss", F.lit(0)), F.lit("")).alias("headline"), F.coalesce(F.get("ls", F.lit(0)), F.lit("")).alias("summary"),
        F.slice("ls", 2, 2_000_000_000).alias("bullets"), F.when(k % 7 == 0, "").otherwise(F.col("lang")).alias("langs"),
        F.when(k % 11 == 0, "").otherwise("on request").alias("refs"), F.when(k % 13 == 0, "").otherwise("diploma").alias("edu_b"), F.lit("").alias("edu_s"),
        F.array_distinct(F.filter(tx.words("text"), lambda w: F.length(w) >= 10)).alias("skills"), (k % 15).cast("int").alias("career_years"),
        (k % 4).cast("int").alias("n_roles"), (k % 3).cast("int").alias("n_unsized"), (k % 2).cast("int").alias("n_old_detailed"), F.col("text").alias("raw"))


def bullets(t):
    p = profile(t).select("doc_id", "doc_lang", F.size("bullets").alias("n_in_role"), "bullets")
    rows = p.select("doc_id", "doc_lang", "n_in_role", F.posexplode("bullets").alias("line_ix", "text"))
    return rows.withColumn("is_template", (F.col("doc_id") + F.col("line_ix")) % 17 == 0).withColumn("is_current", F.lit(False))


Q_PROFILE = rf"""prof AS (SELECT doc_id, lang AS doc_lang, CASE doc_id % 3 WHEN 0 THEN 'gcc' WHEN 1 THEN 'dach' ELSE 'uk' END AS market, source AS name, coalesce({ct.q_emails('text')}[1], '') AS email,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END AS city, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'permit' END AS work_rights, coalesce({tx.q_sentences('text')}[1], '') AS headline, coalesce({tx.q_lines('text')}[1], '') AS summary,
  {tx.q_lines('text')}[2:] AS bullets, CASE WHEN doc_id % 7 = 0 THEN '' ELSE lang END AS langs, CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'on request' END AS refs, CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'diploma' END AS edu_b,
  list_filter(w10, lambda w, i: list_position(w10, w) = i) AS skills, (doc_id % 15)::INT AS career_years, doc_id % 4 AS n_roles, doc_id % 3 AS n_unsized, doc_id % 2 AS n_old_detailed, text AS raw,
  regexp_extract(text, '(\+[0-9][0-9().\x2f \t-]*[0-9])', 1) AS phone FROM (SELECT *, list_filter({tx.q_words('text')}, lambda w: length(w) >= 10) AS w10 FROM documents)),
bul AS (SELECT doc_id, doc_lang, (ix - 1)::INT AS line_ix, text, len(bullets) AS n_in_role, (doc_id + ix - 1) % 17 = 0 AS is_template FROM prof, unnest(bullets) WITH ORDINALITY AS u(text, ix))"""


def q_rules(src: str, rules) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{c}' AS check_id, {s if s.startswith('CASE') else q_str(s)} AS sev, {p if '||' in p else q_str(p)} AS path, {h} AS hit FROM {src} WHERE {cond}" for c, s, cond, p, h in rules)


def q_hits(x: str, words) -> str:
    return rf"regexp_extract_all(regexp_replace({x}, {q_str(li.SEPARATORS)}, '\1\1', 'g'), {q_str(li.term_pattern(words))}, 1)"


def q_terms(src: str, rules) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{c}' AS check_id, '{s}' AS sev, {p if '||' in p else q_str(p)} AS path, unnest({q_hits(x, WORDS[c])}) AS hit FROM {src} WHERE {cond}" for c, s, p, x, cond in rules)


LP = "'lines.' || line_ix::VARCHAR"
FW = r"regexp_replace(lower(regexp_extract(text, '^[\s•▪►✓➢*·-]*(\p{L}[\p{L}''’-]*)', 1)), '^co-', '')"
PAST = f"(ends_with(fw, 'ed') OR fw IN {q_list(cat.IRREGULAR_PAST)})"

Q_L1 = q_rules("prof", [
    ("HDR-01", "high", r"length(regexp_replace(name, '[^\p{L}]', '', 'g')) < 2 OR length(regexp_replace(name, '[^0-9]', '', 'g')) >= 3", "name", "''"),
    ("HDR-02", "high", r"NOT regexp_matches(email, '^[^\s@]+@[^\s@]+\.[A-Za-z]{2,}$')", "email", "''"),
    ("HDR-02", "high", "phone = ''", "phone", "''"), ("HDR-02", "med", "city = ''", "city", "''"),
    ("HDR-05", "CASE WHEN market = 'uk' THEN 'low' ELSE 'med' END", "work_rights = '' AND market <> 'dach'", "work_rights", "''"),
    ("HL-01", "high", "headline = ''", "headline", "''"), ("SUM-01", "high", "summary = ''", "summary", "''"), ("LNG-01", "med", "langs = ''", "langs", "''"),
    ("EDU-01", "CASE WHEN market = 'dach' THEN 'high' ELSE 'med' END", "edu_b = ''", "education", "''"), ("REF-02", "low", "refs = '' AND market <> 'uk'", "refs", "''")])
SKILLS = "array_to_string(skills, ' ; ')"
Q_L2 = (q_terms("prof", [("HL-03", "high", "headline", "headline", "true"), ("HL-05", "med", "headline", "headline", "true"), ("SUM-03", "med", "summary", "summary", "true"),
                         ("SUM-04", "high", "summary", "summary", "true"), ("SUM-10", "low", "summary", "summary", "true"), ("SKL-02", "med", "skills", SKILLS, "true"),
                         ("SKL-04", "low", "skills", SKILLS, "true"), ("MKT-01", "low", "summary", "summary", "market = 'uk' AND doc_lang = 'en'")])
        + " UNION ALL " + q_terms("bul", [("BUL-05", "low", LP, "text", f"NOT is_template AND NOT {tx.q_has_figure('text')}"), ("DOC-05", "low", LP, "text", "doc_lang = 'de'")])
        + " UNION ALL " + q_rules("bul", [("BUL-04", "low", f"regexp_matches({tx.q_norm('text')}, '^(?:the|der|le|el)(?: |$)')", LP, "''")]))


@query("l1_blank_fields", f"WITH {Q_PROFILE} {Q_L1}")
def _(t):
    return li.l1_blank_fields(profile(t))


@query("l2_banned_terms", f"WITH {Q_PROFILE} {Q_L2}")
def _(t):
    return li.l2_terms_docs(profile(t), WORDS).unionByName(li.l2_terms_lines(bullets(t), WORDS))


@query("l3_personal_data", """WITH c AS (SELECT c_custkey AS doc_id, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT doc_id, 'HDR-06' AS check_id, 'high' AS sev, 'header' AS path, 'Nationality' AS hit FROM c WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 'HDR-08', 'high', 'header', 'Married' FROM c WHERE doc_id % 4 = 1
UNION ALL SELECT doc_id, 'HDR-08', 'high', 'header', '2 children' FROM c WHERE doc_id % 4 = 1 UNION ALL SELECT doc_id, 'HDR-07', 'high', 'header', 'born on 12.03.' || (1960 + doc_id % 40)::VARCHAR FROM c WHERE doc_id % 4 = 2
UNION ALL SELECT doc_id, 'HDR-12', 'high', 'header', 'Passport no: AB' || (10000 + doc_id)::VARCHAR FROM c WHERE doc_id % 4 = 3""")
def _(t):
    """Header lines printed from customer rows, scanned with the whole rule table."""
    k = F.col("c_custkey")
    text = (F.when(k % 4 == 0, F.concat(F.lit("Nationality: "), "n_name")).when(k % 4 == 1, F.concat("n_name", F.lit(" | Married | 2 children")))
            .when(k % 4 == 2, F.concat("c_name", F.lit(", born on 12.03."), (1960 + k % 40).cast("string")))
            .otherwise(F.concat(F.lit("Passport no: AB"), (10000 + k).cast("string"))))
    c = join_small(t.customer, t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(k.alias("doc_id"), text.alias("text"))
    return li.l3_personal_data(c, F.lit("header"), "text")


@query("l3_contact_patterns", rf"""SELECT doc_id, 'REF-01' AS check_id, 'high' AS sev, 'text' AS path, unnest(list_concat({ct.q_emails('text')}, list_distinct(regexp_extract_all(text, '(\+[0-9][0-9().\x2f \t-]*[0-9])', 1)))) AS hit FROM documents
UNION ALL SELECT doc_id, 'HDR-12', 'high', 'text', unnest(list_distinct(regexp_extract_all(regexp_replace(text, '([^0-9])', '\1\1', 'g'), {q_str(li.CARD_NUMBER)}, 1))) FROM documents""")
def _(t):
    return li.l3_contact_patterns(t.documents.select("doc_id", "text"), F.lit("text"), "text")


@query("s30_personal_data", rf"""WITH h AS (SELECT doc_id, 'email' AS kind, unnest({ct.q_emails('text')}) AS hit, lower(text) AS t FROM documents UNION ALL SELECT doc_id, 'phone', unnest(list_distinct(regexp_extract_all(text, '(\+[0-9][0-9().\x2f \t-]*[0-9])', 1))), lower(text) FROM documents)
SELECT doc_id, kind, hit, (strpos(t, hit) - 1)::INT AS start, (strpos(t, hit) - 1 + length(hit))::INT AS "end" FROM h""")
def _(t):
    """Addresses and phones with their place in the text; the label and statement kinds run in ``l3_personal_data``."""
    low = F.lower("text")
    rows = t.documents.select("doc_id", low.alias("_t"), F.concat(F.transform(ct.emails("text"), lambda h: F.struct(F.lit("email").alias("kind"), h.alias("hit"))),
                              F.transform(ct.phones("text"), lambda h: F.struct(F.lit("phone").alias("kind"), h.alias("hit")))).alias("_h"))
    spans = rows.select("doc_id", F.explode(F.transform("_h", lambda h: F.struct(h["kind"].alias("kind"), h["hit"].alias("hit"), (F.instr(F.col("_t"), h["hit"]) - 1).cast("int").alias("start")))).alias("h"))
    return spans.select("doc_id", "h.kind", "h.hit", "h.start", (F.col("h.start") + F.length("h.hit")).alias("end"))


def _l4_sql():
    t_, fwq = "trim(text)", FW
    noun = "(regexp_matches(fw, '(?:tion|sion|ment|ance|ence|ship|ity|ness)$') OR fw IN ('the', 'a', 'an'))"
    opens = f"(fw IN ('i', 'my', 'we', 'our', 'me') OR ends_with(fw, 'ing') OR {noun} OR (regexp_matches(fw, '^[a-z]+[^s]s$') AND NOT {PAST}))"
    header = f"(length({t_}) <= 60 AND {q_has_term('text', TITLES)} AND NOT ends_with({t_}, '.') AND NOT {PAST} AND NOT ends_with(fw, 'ing'))"
    frag = (rf"(n_in_role >= 2 AND NOT (regexp_matches({t_}, '^\p{{Lu}}') AND regexp_matches({t_}, '[.!?]$')) AND (regexp_matches({t_}, '^\p{{Ll}}') OR regexp_matches({tx.q_norm('text')}, '^(?:{'|'.join(cat.JOINING_WORDS)})(?: |$)') "
            rf"OR regexp_matches({t_}, '(?:,|&|-)$|(?i:(?:^|\s)(?:and|und|the)$)') OR (length({t_}) < 25 AND NOT {header})))")
    comp = rf"(regexp_matches({tx.q_norm('text')}, '^(?:for|pour)(?: |$)') OR regexp_matches(text, '(?i)(?:founded in|established in|gegründet|headquartered in)(?:\s+\S+){{0,5}}?\s*[0-9]{{4}}|a leading provider') OR len({tx.q_sentences('text')}) >= 3)"
    ats = rf"(regexp_matches(text, '\t|[\x{{E000}}-\x{{F8FF}}]|[\x{{1F300}}-\x{{1FAFF}}]') OR regexp_matches(text, '^\s*[•▪►✓➢–]\s') OR regexp_matches({t_}, ' {{2,}}'))"
    lang = ", ".join(f"{tx.q_votes('text', k)} AS v_{k}" for k in tx.STOPWORDS)
    src = f"(SELECT *, {tx.q_lang_from_votes()} AS l FROM (SELECT *, {fwq} AS fw, {lang} FROM bul))"
    return f"WITH {Q_PROFILE}, b AS (SELECT * FROM {src}) " + q_rules("b", [
        ("BUL-03", "low", f"{opens} AND l = 'en'", LP, "fw"), ("BUL-07", "med", frag, LP, "''"), ("BUL-08", "high", header, LP, "''"),
        ("BUL-09", "med", f"{comp} AND NOT is_template", LP, "''"), ("ATS-01", "low", ats, LP, "''")])


@query("l4_shape_rules", _l4_sql())
def _(t):
    return li.l4_shapes_lines(bullets(t), TITLES, COMPANY)


def _l5_sql():
    sw, sn, n = tx.q_word_count("summary"), f"len({tx.q_sentences('summary')})", "len(bullets)"
    figs = f"len(list_filter(bullets, lambda b_: {tx.q_has_figure('b_')}))"
    scope = ("staff", "team", "division", "founded", "promoted", "companies")
    total = f"(sw + list_sum(list_concat([0], list_transform(bullets, lambda b_: {tx.q_word_count('b_')}))))"
    return f"""WITH {Q_PROFILE}, p AS (SELECT *, {sw} AS sw, {sn} AS sn, {figs} AS figs, len(skills) AS nk FROM prof), q AS (SELECT *, {total} AS total FROM p) """ + q_rules("q", [
        ("HL-04", "CASE WHEN length(trim(headline)) > 120 THEN 'med' ELSE 'low' END", "length(trim(headline)) > 90", "headline", "''"),
        ("SUM-02", "CASE WHEN sw < 45 OR sw > 120 OR sn < 2 OR sn > 5 THEN 'med' ELSE 'low' END", "summary <> '' AND (sw < 60 OR sw > 90 OR sn < 3 OR sn > 4)", "summary", "''"),
        ("SUM-09", "low", f"summary <> '' AND NOT {tx.q_has_figure('summary')} AND NOT {q_has_term('summary', scope)}", "summary", "''"),
        ("MET-01", "med", f"{n} >= 3 AND (200 * figs + {n}) // (2 * {n}) < 40", "experience", "''"),
        ("SKL-03", "CASE WHEN nk = 0 THEN 'med' ELSE 'low' END", "nk NOT BETWEEN 5 AND 12", "skills", "''"),
        ("MKT-04", "low", "total > CASE WHEN career_years >= 8 THEN 950 ELSE 550 END", "experience", "''")]) + " UNION ALL " + q_rules("bul", [
        ("BUL-02", "CASE WHEN length(trim(text)) > 260 THEN 'med' ELSE 'low' END", "length(trim(text)) > 180", LP, "''")])


@query("l5_length_bands", _l5_sql())
def _(t):
    return li.l5_lengths(profile(t))


@query("l5_role_bands", Q_RECENCY + """, c AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM ranked)
SELECT o_custkey AS doc_id, 'BUL-01' AS check_id, 'low' AS sev, 'roles.' || o_orderkey::VARCHAR AS path, n_lines::VARCHAR AS hit FROM c WHERE NOT (CASE WHEN recency = 0 THEN n_lines BETWEEN 4 AND 6 WHEN recency <= 2 THEN n_lines BETWEEN 2 AND 4 ELSE n_lines <= 3 END)
UNION ALL SELECT o_custkey, 'EXP-11', 'low', 'roles.' || o_orderkey::VARCHAR, '' FROM c WHERE n >= 5 AND recency >= 4 AND o_orderkey % 2 = 0 AND to_ix // 12 <= 2012 - 15""")
def _(t):
    r = _ranked(t)
    n = t.order_roles.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_roles"))
    j = r.join(n, "o_custkey").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("role_ix"), "recency", "n_lines", "n_roles", "to_ix", (F.col("o_orderkey") % 2 != 0).alias("is_current"))
    return li.l5_roles(j, 2012)


Q_L6 = rf"""f AS (SELECT * FROM ({_q_figures('(SELECT doc_id, line_ix, text AS line FROM bul UNION ALL SELECT doc_id, -1, summary FROM prof)')}) WHERE (glued = '' OR unit <> '') AND NOT regexp_matches(value, '^(?:19[5-9]\d|20[0-3]\d)$'))
SELECT c.doc_id, 'SUM-07' AS check_id, 'high' AS sev, 'summary' AS path, c.value AS hit FROM f c WHERE c.line_ix = -1 AND NOT EXISTS (SELECT 1 FROM f s WHERE s.doc_id = c.doc_id AND s.line_ix >= 0 AND s.value = c.value AND (c.unit <> '' OR len(list_intersect(c.nxt, s.nxt)) > 0))"""


@query("l6_orphan_figures", f"WITH {Q_PROFILE}, {Q_L6}")
def _(t):
    return li.l6_orphan_figures(profile(t), bullets(t))


@query("l6_skills_without_evidence", rf"""WITH {Q_PROFILE}, k AS (SELECT doc_id, skill, ix FROM prof, unnest(skills) WITH ORDINALITY AS u(skill, ix)), st AS (SELECT DISTINCT doc_id, {tx.q_stem('w')} AS s FROM (SELECT doc_id, unnest({tx.q_words('text')}) AS w FROM bul))
SELECT k.doc_id, 'SKL-01' AS check_id, 'med' AS sev, 'skills.' || (ix - 1)::VARCHAR AS path, skill AS hit FROM k WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.doc_id = k.doc_id AND st.s = {tx.q_stem('skill')})""")
def _(t):
    return li.l6_skills_without_evidence(profile(t), bullets(t))


@query("l6_consistency", rf"""WITH {Q_PROFILE} SELECT doc_id, 'HDR-04' AS check_id, 'med' AS sev, 'city' AS path, city AS hit FROM prof WHERE CASE WHEN starts_with(replace(replace(phone, ' ', ''), '-', ''), '+1(1') THEN 'A' WHEN starts_with(replace(replace(phone, ' ', ''), '-', ''), '+1') THEN 'B' END <> CASE WHEN city = 'src1' THEN 'A' WHEN city = 'src2' THEN 'B' WHEN city = 'src3' THEN 'C' WHEN city = 'src14' THEN 'A' END""")
def _(t):
    """Only the dial-code rule can fire on this text; the other rules of the pass are proven on fixtures."""
    return li.l6_consistency_docs(profile(t), **DIAL)


@query("l6_titles_never_held", """SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 4 = 1 THEN 'ceo' ELSE 'director' END AS hit FROM customer WHERE c_custkey % 4 = 1 OR (c_custkey % 4 = 2 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority <> '1-URGENT') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'))
OR (c_custkey % 4 = 2 AND c_custkey NOT IN (SELECT o_custkey FROM orders))""")
def _(t):
    """Customers as profiles, orders as held titles: urgent ones are directors, the others deputy directors."""
    k = F.col("c_custkey")
    docs = t.customer.select(k.alias("doc_id"), F.when(k % 4 == 0, "Retail").when(k % 4 == 1, "CEO, Retail").when(k % 4 == 2, "Director, Retail").otherwise("Retail and more").alias("headline"))
    roles = t.orders.select(F.col("o_custkey").alias("doc_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "Sales Director").otherwise("Deputy Sales Director").alias("title"))
    return li.l6_titles_never_held(docs, roles).select("doc_id", "hit")


@query("met02_recent_roles_without_figure", Q_RECENCY + """ SELECT r.o_custkey AS doc_id, 'MET-02|' || r.o_orderkey::VARCHAR AS key, r.recency FROM ranked r JOIN lineitem ON l_orderkey = r.o_orderkey WHERE recency <= 2 GROUP BY ALL HAVING NOT bool_or(l_quantity >= 25)""")
def _(t):
    """Line items as lines: a large quantity is printed as a figure, a small one is not."""
    lines = _ranked(t).join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("role_ix"), "recency", F.when(F.col("l_quantity") >= 25, F.concat(F.lit("moved "), F.col("l_quantity").cast("int").cast("string"), F.lit(" units"))).otherwise("moved goods").alias("text"),
        F.lit(False).alias("is_template"))
    return li.recent_roles_without_figure(lines).select("doc_id", "key", "recency")


@query("l7_role_pairs", f"""WITH {Q_ORDER_ROLES}, l AS (SELECT * FROM order_roles WHERE to_ix - from_ix >= 1)
SELECT a.o_custkey AS doc_id, 'EXP-08' AS check_id, 'med' AS sev, 'roles.' || a.o_orderkey::VARCHAR AS path, count(*)::VARCHAR AS hit FROM l a JOIN l b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey
WHERE least(a.to_ix, b.to_ix) - greatest(a.from_ix, b.from_ix) + 1 >= 2 GROUP BY a.o_custkey, a.o_orderkey
UNION ALL SELECT o_custkey, 'EXP-07', 'med', 'roles.' || o_orderkey::VARCHAR, pk::VARCHAR FROM (SELECT o_custkey, o_orderkey, to_ix, lag(to_ix) OVER w AS pt, lag(o_orderkey) OVER w AS pk FROM order_roles WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE pt < to_ix""")
def _(t):
    return li.l7_pairs(t.order_roles.select("o_custkey", "o_orderkey", "from_ix", "to_ix"), "o_custkey", "o_orderkey")


@query("l7_duplicate_lines", f"SELECT doc_id, 'BUL-06' AS check_id, CASE WHEN kind = 'exact' THEN 'med' ELSE 'low' END AS sev, 'lines.' || line_ix::VARCHAR AS path, partner_ix::VARCHAR AS hit FROM ({Q_NEAR})")
def _(t):
    return li.l7_lines(t.paragraphs.withColumnRenamed("line", "text"))


@query("l8_timeline", Q_ISLANDS + f""", n AS (SELECT *, lead(from_ix) OVER (PARTITION BY o_custkey ORDER BY from_ix) AS nx FROM islands), o AS (SELECT o_custkey, bool_or(o_orderstatus = 'O') AS op FROM order_roles GROUP BY 1),
g AS (SELECT o_custkey, (CASE WHEN nx IS NOT NULL THEN nx - 1 WHEN NOT op AND {TODAY} - to_ix >= 6 THEN {TODAY} END)::INT - to_ix AS months FROM n JOIN o USING (o_custkey)),
f AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS mm, count(*) FILTER (WHERE o_orderkey % 3 = 1) AS mon, count(*) FILTER (WHERE o_orderkey % 3 = 2) AS y FROM order_roles GROUP BY 1)
SELECT o_custkey AS doc_id, 'EXP-09' AS check_id, CASE WHEN months > 12 THEN 'med' ELSE 'low' END AS sev, 'experience' AS path, months::VARCHAR AS hit FROM g WHERE months >= 6
UNION ALL SELECT o_custkey, 'EXP-05', 'med', 'experience', mm::VARCHAR || '/' || mon::VARCHAR FROM f WHERE mm > 0 AND mon > 0 UNION ALL SELECT o_custkey, 'EXP-05', 'low', 'experience', y::VARCHAR FROM f WHERE mm + mon > 0 AND y > 0
UNION ALL SELECT o_custkey, 'MKT-02', 'low', 'experience', mm::VARCHAR FROM f WHERE mm * 2 > mm + mon""")
def _(t):
    k = F.col("o_orderkey") % 3
    fmt = F.when(k == 0, "MM/YYYY").when(k == 1, "Mon YYYY").otherwise("YYYY")
    return li.l8_timeline(t.order_roles, "o_custkey", TODAY, F.col("o_orderstatus") == "O", fmt)


def _lang_cols(x):
    return ", ".join(f"{tx.q_votes(x, k)} AS v_{k}" for k in tx.STOPWORDS)


@query("l9_language_share", f"""WITH {Q_PROFILE}, bl AS (SELECT doc_id, doc_lang, {tx.q_lang_from_votes()} AS l FROM (SELECT doc_id, doc_lang, {_lang_cols('text')} FROM bul)), bs AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE l = doc_lang) AS k FROM bl WHERE l <> 'unknown' GROUP BY 1),
s AS (SELECT doc_id, doc_lang, {tx.q_lang_from_votes()} AS l FROM (SELECT doc_id, doc_lang, {_lang_cols('summary')} FROM prof)),
se AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, doc_lang, {tx.q_lang_from_votes()} AS l FROM (SELECT doc_id, doc_lang, {_lang_cols('x')} FROM (SELECT doc_id, doc_lang, unnest({tx.q_sentences('summary')}) AS x FROM prof) WHERE {tx.q_word_count('x')} >= 8)) WHERE l <> 'unknown' AND l <> doc_lang)
SELECT doc_id, 'DOC-01' AS check_id, 'high' AS sev, 'experience' AS path, '' AS hit FROM bs WHERE n >= 3 AND k * 2 < n
UNION ALL SELECT doc_id, 'DOC-02', 'high', 'summary', CASE WHEN l <> 'unknown' AND l <> doc_lang THEN l ELSE '' END FROM s WHERE (l <> 'unknown' AND l <> doc_lang) OR doc_id IN (SELECT doc_id FROM se)""")
def _(t):
    """Every third document is declared in another language, so foreign lines occur."""
    p = profile(t)
    return li.l9_languages(p)


@query("l10_template_lines", f"WITH {Q_PROFILE} SELECT doc_id, 'ACH-01' AS check_id, 'high' AS sev, {LP} AS path, '' AS hit FROM bul WHERE is_template")
def _(t):
    return li.l10_templates(bullets(t))


Q_SKILLS = rf"""s AS (SELECT doc_id, ix - 1 AS ix, skill, list_distinct(list_filter({tx.q_letter_words('skill')}, lambda w: length(w) >= 3 AND w NOT IN ('and', 'und'))) AS s FROM prof, unnest(skills) WITH ORDINALITY AS u(skill, ix)),
w AS (SELECT doc_id, ix, s, unnest(s) AS w FROM s), p AS (SELECT a.doc_id, a.ix, min(b.ix) AS other FROM s a JOIN w b ON a.doc_id = b.doc_id AND b.w = a.s[1] AND a.ix <> b.ix
  WHERE len(list_filter(a.s, lambda x: NOT list_contains(b.s, x))) = 0 AND (len(a.s) < len(b.s) OR a.ix < b.ix) GROUP BY ALL)
SELECT doc_id, 'SKL-05' AS check_id, 'low' AS sev, 'skills.' || ix::VARCHAR AS path, 'skills.' || other::VARCHAR AS hit FROM p
UNION ALL SELECT doc_id, 'SKL-05', 'low', 'skills.' || ix::VARCHAR, skill FROM s WHERE regexp_matches(trim(skill), '^\p{{Ll}}')"""


@query("l7_skills", f"WITH {Q_PROFILE}, {Q_SKILLS}")
def _(t):
    """Skills are the long words; pairs of them arise where a word breaks at a digit."""
    return li.l7_skills(profile(t))


@query("l6_language_levels", """SELECT doc_id, 'LNG-02' AS check_id, CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE 'med' END AS sev, 'langs' AS path, CASE WHEN doc_id % 3 = 0 THEN 'german' ELSE 'english' END AS hit
FROM documents WHERE doc_id % 3 < 2""")
def _(t):
    """Levels printed after the first line: German native and fluent, English native and fluent, or one level only."""
    k = F.col("doc_id") % 3
    langs = F.when(k == 0, "Deutsch Muttersprache · English fluent").when(k == 1, "English (native)").otherwise("Deutsch Muttersprache; English fluent")
    added = F.when(k == 0, " Fluent in English and German.").when(k == 1, " English, French: fluent.").otherwise(" Native German-speaking markets, fluent English.")
    return li.l6_language_levels(profile(t).withColumn("langs", langs).withColumn("summary", F.concat("summary", added)))


# ---- all families, acknowledgements and scores


def found(t):
    """Instances of every family over documents and lines."""
    return li.lint_all(profile(t), bullets(t), words=WORDS, title_words=TITLES, company_openers=COMPANY, **DIAL)


def live(t):
    """What counts: every sixth document has its blank-field findings acknowledged (high ones count all the same), and the checks that
    wait for the builder are left out."""
    acks = li.l1_blank_fields(profile(t)).where("doc_id % 6 = 0").select(li.instance_key().alias("key"))
    return li.live_instances(found(t), acks, F.lit(False))


Q_PERSONAL = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS check_id, 'high' AS sev, 'text' AS path, unnest(regexp_extract_all(text, {q_str(p)}, 1)) AS hit FROM documents" for c, _, p in li.PERSONAL_RULES)
Q_FAMILIES = [f"WITH {Q_PROFILE} {Q_L1}", f"WITH {Q_PROFILE} {Q_L2}", Q_PERSONAL, f"WITH {Q_PROFILE}, {Q_SKILLS}", f"WITH {Q_PROFILE} " + q_rules("prof", [
    ("EDU-04", "low", "market = 'dach' AND edu_b <> ''", "education.0.b", "edu_b")])] + [
    ORACLES[n] for n in ("l3_contact_patterns", "l4_shape_rules", "l5_length_bands", "l6_orphan_figures", "l6_skills_without_evidence", "l6_consistency", "l9_language_share", "l10_template_lines")]
Q_FAMILIES.append(f"SELECT doc_id, 'BUL-06' AS check_id, CASE WHEN kind = 'exact' THEN 'med' ELSE 'low' END AS sev, 'lines.' || line_ix::VARCHAR AS path, partner_ix::VARCHAR AS hit FROM ({q_near(Q_PROFILE, 'bul', 'text')})")
Q_FOUND = " UNION ALL ".join(f"SELECT doc_id, check_id, sev, path, hit FROM ({q})" for q in Q_FAMILIES)
Q_L1_CHECKS = ("HDR-01", "HDR-02", "HDR-05", "HL-01", "SUM-01", "LNG-01", "EDU-01", "REF-02")
Q_LIVE = f"SELECT * FROM ({Q_FOUND}) WHERE NOT (doc_id % 6 = 0 AND sev <> 'high' AND check_id IN {q_list(Q_L1_CHECKS)}) AND check_id NOT IN {q_list(cat.DEFERRED)}"


@query("lint_all", Q_FOUND)
def _(t):
    return found(t)


Q_PEN = f"""WITH found AS ({Q_LIVE}), n AS (SELECT doc_id, check_id, sev, count(*)::INT AS n FROM found GROUP BY ALL),
pen AS (SELECT *, (CASE sev WHEN 'high' THEN 15 + least(10, 5 * (n - 1)) WHEN 'med' THEN 5 + least(4, 2 * (n - 1)) ELSE 1 END)::INT AS penalty FROM n)"""
Q_GATE = f"check_id IN {q_list(cat.GATES)} AND sev = 'high'"
Q_SCORES = f""", tot AS (SELECT doc_id, sum(penalty)::INT AS lost, bool_or({Q_GATE}) AS gated FROM pen GROUP BY 1), sc AS (SELECT *, greatest(0, 100 - lost)::INT AS raw_score, (CASE WHEN gated THEN least(59, greatest(0, 100 - lost)) ELSE greatest(0, 100 - lost) END)::INT AS score FROM tot)"""
Q_PARTS = "CASE " + " ".join(f"WHEN check_id IN {q_list([r[0] for r in cat.checks() if r[1] == p])} THEN '{p}'" for p in cat.PART_ORDER) + " END"
Q_CARD = f""", pc AS (SELECT doc_id, {Q_PARTS} AS part, check_id, sum(penalty)::INT AS p, bool_or({Q_GATE}) AS g FROM pen GROUP BY ALL),
card AS (SELECT doc_id, part, sum(p)::INT AS lost, bool_or(g) AS gated, string_agg(check_id, ',' ORDER BY p DESC, NOT g, check_id) AS checks FROM pc GROUP BY ALL), cards AS (SELECT *, least(CASE WHEN gated THEN 59 ELSE 100 END, greatest(0, 100 - lost))::INT AS score FROM card)"""


@query("e8_lint_penalty", Q_PEN + " SELECT doc_id, check_id, sev, n, penalty FROM pen")
def _(t):
    return li.penalties(live(t))


@query("e9_lint_score", Q_PEN + Q_SCORES + " SELECT *, CASE WHEN gated THEN 'not ready' WHEN score >= 85 THEN 'ready' WHEN score >= 70 THEN 'ready after fixes' ELSE 'needs work' END AS verdict FROM sc")
def _(t):
    return li.scores(li.penalties(live(t)))


def _sections_sql():
    cols = []
    for n in dict.fromkeys(cat.SECTIONS.values()):
        pre = [k for k, v in cat.SECTIONS.items() if v == n]
        cols.append(f"greatest(0, 100 - coalesce(sum(penalty) FILTER (WHERE split_part(check_id, '-', 1) IN {q_list(pre)}), 0))::INT AS {n.lower().replace(' ', '_')}")
    return Q_PEN + " SELECT doc_id, " + ", ".join(cols) + " FROM pen GROUP BY 1"


@query("e9_section_scores", _sections_sql())
def _(t):
    return li.section_scores(li.penalties(live(t)))


@query("e10_scorecard", Q_PEN + Q_CARD + " SELECT doc_id, part, lost, gated, checks, score FROM cards")
def _(t):
    return li.scorecard(li.penalties(live(t)))


@query("g8_worst_first", Q_PEN + Q_SCORES + Q_CARD + f""" SELECT doc_id, part, part_score, score FROM (SELECT c.doc_id, c.part, c.score AS part_score, s.score AS score,
  row_number() OVER (PARTITION BY c.doc_id ORDER BY c.score, NOT c.gated, c.lost DESC, list_position({list(cat.PART_ORDER)}, c.part)) AS rk FROM cards c JOIN sc s ON c.doc_id = s.doc_id WHERE s.score < 85 AND (NOT s.gated OR c.gated)) WHERE rk = 1""")
def _(t):
    pen = li.penalties(live(t))
    return li.worst_first(li.scorecard(pen), li.scores(pen))


@query("e11_rule_coverage", f"""WITH used AS (SELECT DISTINCT check_id FROM ({f'WITH {Q_PROFILE} ' + Q_L1 + ' UNION ALL ' + Q_L2}))
SELECT check_id, 'unmapped' AS problem FROM used WHERE check_id IN ('HL-05', 'SUM-10') UNION ALL SELECT 'OLD-' || n_nationkey::VARCHAR, 'stale' FROM nation WHERE n_nationkey < 3 UNION ALL SELECT check_id, 'bad target' FROM used WHERE check_id = 'BUL-05'""")
def _(t):
    """Checks that fire, against a mapping with two gaps, three stale rows and one wrong part."""
    used = found(t).select("check_id").distinct()
    table = li.cat.check_table(t.spark).where("check_id NOT IN ('HL-05', 'SUM-10')").select("check_id", F.when(F.col("check_id") == "BUL-05", "nowhere").otherwise(F.col("part")).alias("part"))
    stale = t.nation.where("n_nationkey < 3").select(F.concat(F.lit("OLD-"), F.col("n_nationkey").cast("string")).alias("check_id"), F.lit("ats").alias("part"))
    # the documents are linted once: checks of the catalogue that do not fire leave the report after the comparison, not the mapping before it
    report = li.rule_coverage(used, table.unionByName(stale), list(cat.PART_ORDER))
    return report.where((F.col("problem") != "stale") | ~F.col("check_id").isin(*[c[0] for c in cat.checks()]))


Q_QUEST = f"""q AS (SELECT doc_id, line_ix AS pos, doc_id::VARCHAR || '-' || line_ix::VARCHAR AS key, line_ix % 9 = 4 AS gate, CASE WHEN line_ix % 4 <> 3 THEN line_ix // 5 END AS recency, line_ix % 2 = 0 AS is_figure, line_ix // 5 AS role FROM bul)"""


@query("e19_open_questions", f"""WITH {Q_PROFILE}, {Q_QUEST}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN gate THEN 0 WHEN recency IS NOT NULL THEN 1 ELSE 2 END, coalesce(recency, 99), pos) AS o FROM q),
f AS (SELECT *, sum(is_figure::INT) OVER (PARTITION BY doc_id, role ORDER BY o) AS f FROM o), k AS (SELECT *, true AS ok FROM f), n AS (SELECT *, sum(ok::INT) OVER (PARTITION BY doc_id ORDER BY o) AS n FROM k)
SELECT doc_id, key, n::INT AS place FROM n WHERE ok""")
def _(t):
    """Every line asks one question; five lines make a role."""
    ix = F.col("line_ix")
    q = bullets(t).select("doc_id", F.concat_ws("-", F.col("doc_id").cast("string"), ix.cast("string")).alias("key"), (ix % 9 == 4).alias("gate"),
                          F.when(ix % 4 != 3, F.floor(ix / 5)).alias("recency"), (ix % 2 == 0).alias("is_figure"), F.floor(ix / 5).alias("role"), ix.alias("pos"))
    return li.open_questions(q)


BUZZ = ("and the", "of the", "de la", "in der", "para")


def _quick_sql():
    n, fig = "len(bullets)", tx.q_has_figure("b_")
    fw = r"regexp_replace(lower(regexp_extract(b_, '^[\s•▪►✓➢*·-]*(\p{L}[\p{L}''’-]*)', 1)), '^co-', '')"
    hay = f"' ' || {tx.q_norm('array_to_string(bullets, chr(32)) || chr(32) || summary')} || ' '"
    buzz = " + ".join(f"contains(hay, ' {w} ')::INT" for w in BUZZ)
    pers = q_str(li._L(cat.NATIONALITY_LABELS + cat.BIRTH_LABELS + cat.MARITAL_LABELS + cat.RELIGION_LABELS))
    return f"""WITH {Q_PROFILE}, a AS (SELECT *, {n} AS n, len(list_filter(bullets, lambda b_: {fig})) AS figs, len(list_filter(bullets, lambda b_: regexp_matches({tx.q_norm('b_')}, '^(?:the|der|le|el)(?: |$)'))) AS weak, {hay} AS hay,
  len(list_filter(bullets, lambda b_: {q_has_term('b_', ('i', 'my', 'ich', 'mein'))})) AS pron, {tx.q_word_count('summary')} AS sw, list_filter(list_transform(bullets, lambda b_: {fw}), lambda w: length(w) > 3) AS fws FROM prof),
b AS (SELECT doc_id, CASE WHEN n > 0 AND (200 * figs + n) // (2 * n) < 20 THEN 'high' WHEN n > 0 AND (200 * figs + n) // (2 * n) < 50 THEN 'med' END AS figures, CASE WHEN weak > 2 THEN 'high' WHEN weak > 0 THEN 'med' END AS openers,
  CASE WHEN ({buzz}) > 3 THEN 'med' WHEN ({buzz}) > 0 THEN 'low' END AS buzzwords, CASE WHEN pron > 1 THEN 'low' END AS pronouns, CASE WHEN sw = 0 THEN 'high' WHEN sw > 80 THEN 'med' WHEN NOT {tx.q_has_figure('summary')} THEN 'low' END AS summary,
  CASE WHEN n_unsized > 1 THEN 'med' WHEN n_unsized > 0 THEN 'low' END AS scale, CASE WHEN len(list_filter(fws, lambda w: len(list_filter(fws, lambda v: v = w)) >= 3)) > 0 THEN 'low' END AS verbs, CASE WHEN n > 28 THEN 'med' END AS length,
  CASE WHEN email = '' OR phone = '' OR n_roles = 0 THEN 'high' END AS ats, CASE WHEN n_old_detailed > 0 THEN 'low' END AS earlier, CASE WHEN regexp_matches(raw, {pers}) THEN 'med' END AS personal FROM a)
SELECT *, greatest(0, 100 - 9 * ({' + '.join(f"coalesce(CASE {c} WHEN 'high' THEN 3 WHEN 'med' THEN 2 WHEN 'low' THEN 1 END, 0)" for c in ('figures', 'openers', 'buzzwords', 'pronouns', 'summary', 'scale', 'verbs', 'length', 'ats', 'earlier', 'personal'))}))::INT AS score FROM b"""


@query("l11_quick_review", _quick_sql())
def _(t):
    return li.quick_review(profile(t), ("the", "der", "le", "el"), BUZZ)


@query("l12_line_hints", f"""WITH {Q_PROFILE}, b AS (SELECT *, {FW} AS fw FROM bul) SELECT doc_id, line_ix, array_to_string(list_filter([CASE WHEN regexp_matches({tx.q_norm('text')}, '^(?:the|der|le|el)(?: |$)') THEN 'opener' WHEN NOT ({PAST} OR regexp_matches(fw, '^[a-z]+s$')) THEN 'verb' END,
  CASE WHEN length(trim(text)) > 180 THEN 'length' END, CASE WHEN {q_has_term('text', WORDS['BUL-05'])} THEN 'qualifier' END, CASE WHEN {q_has_term('text', ('i', 'my', 'ich', 'mein'))} THEN 'pronoun' END, CASE WHEN NOT {tx.q_has_figure('text')} THEN 'figure' END], lambda x: x IS NOT NULL), ',') AS hints FROM b""")
def _(t):
    return li.line_hints(bullets(t), WORDS["BUL-05"], ("the", "der", "le", "el"))


@query("l13_screen_verdict", f"""WITH r AS (SELECT d.doc_id, coalesce(toxic, 0) = 1 AS gated, d.doc_id % 19 = 0 AS blocked, coalesce(quality, 1) = 1 AS top_ok, lang = 'en' AS title_ok, d.doc_id % 5 <> 0 AS current_ok, n_chars > 600 AS figure_ok, (d.doc_id % 4)::INT AS n_must, least(d.doc_id % 4, n_chars % 3)::INT AS n_kept
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, CASE WHEN gated OR blocked OR (n_must > 0 AND n_kept = 0) THEN 'skip' WHEN top_ok AND title_ok AND current_ok AND figure_ok AND n_kept >= least(2, n_must) THEN 'shortlist' ELSE 'maybe' END AS verdict,
  array_to_string(list_filter([CASE WHEN gated THEN 'V-GATE' END, CASE WHEN blocked THEN 'V-BLOCK' END, CASE WHEN NOT top_ok THEN 'V-TOP' END, CASE WHEN NOT title_ok THEN 'V-TITLE' END, CASE WHEN NOT current_ok THEN 'V-CURRENT' END, CASE WHEN NOT figure_ok THEN 'V-FIG' END, CASE WHEN n_kept < least(2, n_must) THEN 'V-MUST' END], lambda x: x IS NOT NULL), ',') AS against FROM r""")
def _(t):
    k = F.col("doc_id")
    r = t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", (F.coalesce("toxic", F.lit(0)) == 1).alias("gated"), (k % 19 == 0).alias("blocked"), (F.coalesce("quality", F.lit(1)) == 1).alias("top_ok"), (F.col("lang") == "en").alias("title_ok"),
        (k % 5 != 0).alias("current_ok"), (F.col("n_chars") > 600).alias("figure_ok"), (k % 4).cast("int").alias("n_must"), F.least(k % 4, F.col("n_chars") % 3).cast("int").alias("n_kept"))
    return li.screen_verdict(r)


_SEC_ORDER = list(dict.fromkeys(cat.SECTIONS))


@query("l14_top_rejection", Q_PEN + f""" SELECT doc_id, check_id, sev, path FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY check_id NOT IN {q_list(cat.GATES)}, CASE sev WHEN 'high' THEN 0 WHEN 'med' THEN 1 ELSE 2 END, list_position({_SEC_ORDER}, split_part(check_id, '-', 1)), path, check_id) AS rk FROM found) WHERE rk = 1""")
def _(t):
    return li.top_rejection(live(t))


def zone_rows(t):
    """Headline, summary sentences and lines as printed lines; five lines make a role, the first role is the newest."""
    p = profile(t).select("doc_id", "headline", tx.sentences("summary").alias("ss"), "bullets")
    head = p.select("doc_id", F.lit("headline").alias("kind"), F.lit(0).alias("ix"), F.lit(None).cast("long").alias("recency"), F.col("headline").alias("text"))
    summ = p.select("doc_id", F.lit("summary").alias("kind"), F.posexplode("ss").alias("ix", "text")).select("doc_id", "kind", "ix", F.lit(None).cast("long").alias("recency"), "text")
    bul = p.select("doc_id", F.posexplode("bullets").alias("pos", "text")).select(
        "doc_id", F.when(F.col("pos") % 5 == 0, "role").otherwise("bullet").alias("kind"), (F.col("pos") % 5 - 1).cast("int").alias("ix"), F.floor(F.col("pos") / 5).alias("recency"), "text")
    return head.unionByName(summ).unionByName(bul)


Q_ZONE = f"""{Q_PROFILE}, z AS (SELECT doc_id, 'headline' AS kind, 0 AS ix, NULL::BIGINT AS recency, headline AS text FROM prof UNION ALL SELECT doc_id, 'summary', (i - 1)::INT, NULL, x FROM prof, unnest({tx.q_sentences('summary')}) WITH ORDINALITY AS u(x, i)
  UNION ALL SELECT doc_id, CASE WHEN line_ix % 5 = 0 THEN 'role' ELSE 'bullet' END, (line_ix % 5 - 1)::INT, line_ix // 5, text FROM bul),
zone AS (SELECT * FROM z WHERE kind = 'headline' OR (kind = 'summary' AND ix = 0) OR (recency = 0 AND (kind = 'role' OR (kind = 'bullet' AND ix < 2))))"""


@query("l15_top_zone", f"WITH {Q_ZONE} SELECT doc_id, kind, ix, md5(text) AS text_key FROM zone")
def _(t):
    return li.top_zone(zone_rows(t)).select("doc_id", "kind", "ix", F.md5("text").alias("text_key"))


def zone_tokens(t):
    """Words of the next document that are a lexicon's concepts, as every must-have is; others meet no row of the report."""
    words = t.documents.select((F.col("doc_id") - 1).alias("doc_id"), F.posexplode(tx.as_made(tx.words("text"))).alias("pos", "token"))
    return join_small(words, t.lexicon.select(F.col("concept").alias("token")), "token").select("doc_id", "token", (F.col("pos") < 30).alias("in_zone"))


@query("l16_evidence_zone", f"""{Q_REPORT}, tk AS (SELECT doc_id, w AS concept, bool_or(pos <= 30) AS z FROM (SELECT doc_id, {tx.q_words('text')} AS ws FROM documents) d, unnest(d.ws) WITH ORDINALITY AS u(w, pos) GROUP BY ALL)
SELECT r.doc_id, r.concept, CASE WHEN z THEN 'keep' WHEN z IS NOT NULL THEN 'move' ELSE state END AS zone FROM report r LEFT JOIN tk ON tk.doc_id = r.doc_id + 1 AND tk.concept = r.concept""")
def _(t):
    """The next document stands in as the profile; its first thirty words are the zone."""
    return li.evidence_zone(report_rows(t), zone_tokens(t)).select("doc_id", "concept", "zone")


FAM = (("director", 5, ("thou", "les")), ("manager", 4, ("and", "und")), ("staff", 1, ("the", "la", "der")))


def _fam(text):
    return F.array_compact(F.array(*[F.when(tx.has_term(text, w), F.struct(F.lit(r).alias("rank"), F.lit(f).alias("family"))) for f, r, w in FAM]))


Q_FAM = "CASE " + " ".join(f"WHEN {q_has_term('text', w)} THEN {r}" for f, r, w in FAM) + " END"


@query("l17_zone_catches", f"""WITH {Q_ZONE}, i AS (SELECT *, CASE kind WHEN 'headline' THEN 0 WHEN 'summary' THEN 1 WHEN 'role' THEN 2 ELSE 3 + ix END AS p, {Q_FAM} AS rk, {tx.q_figure_runs('text')} AS fr FROM zone)
SELECT doc_id, CASE max(rk) WHEN 5 THEN 'director' WHEN 4 THEN 'manager' WHEN 1 THEN 'staff' END AS title_family, arg_min(trim(fr[1]), p) FILTER (WHERE len(fr) > 0) AS first_figure, min(p) FILTER (WHERE {q_has_term('text', tx.OPEN_WORDS)})::INT AS open_date_ix FROM i GROUP BY 1""")
def _(t):
    z = li.top_zone(zone_rows(t)).select("doc_id", F.when(F.col("kind") == "headline", 0).when(F.col("kind") == "summary", 1).when(F.col("kind") == "role", 2).otherwise(F.col("ix") + 3).alias("ix"), "text")
    return li.zone_catches(z, _fam)


@query("l18_title_mismatch", f"""WITH {Q_PROFILE}, h AS (SELECT doc_id, {q_has_term('headline', FAM[0][2])} AS d, {q_has_term('headline', FAM[1][2])} AS m, {q_has_term('headline', FAM[2][2])} AS s FROM prof)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'director' ELSE 'staff' END AS family FROM h WHERE NOT CASE WHEN doc_id % 2 = 0 THEN d OR m ELSE s END""")
def _(t):
    """Even documents aim at director, odd ones at staff; near pairs are the fixed table."""
    p = profile(t)
    heads = p.select("doc_id", F.explode(_fam("headline")).alias("f")).select("doc_id", "f.family")
    targets = p.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "director").otherwise("staff").alias("family"))
    near = t.spark.createDataFrame(list(cat.NEAR_PAIRS), "a string, b string")
    return li.title_mismatch(heads, targets, near)


# ---- the whole job, roles and places included

_PLACES = ("dubai", "emirates", "paris", "france", "gulf")
_ROLE_TITLES = ("Sales Manager", "3 years", "Dubai", "", "Head of Trading", "Trading LLC", "- Clerk", "Deputy Director", "Jan 2019")
_ROLE_FIRMS = ("{n} Trading LLC", "Dubai", "", "{n}, Lyon", "{n} Group -", "{n} Holding")
_ROLE_DATES = ("{a}/{y} - {b}/{z}", "{y} – {z}", "{a}/{y} – present", "gestern", "", "{b}/2031 – {a}/2032", "{a}/{z} – {b}/{y}", "{y} -- {z}", "seit {y}", "- {a}/{y}")


def roles_of_documents(t):
    """Orders as roles of the document that has their customer's number, printed in many ways, dates read from what is printed."""
    k = F.col("o_orderkey")
    pick = lambda forms, i: F.element_at(F.array(*map(F.lit, forms)), (i % len(forms) + 1).cast("int"))
    two = lambda ix: F.lpad((F.col(ix) % 12 + 1).cast("string"), 2, "0")
    year = lambda ix: F.floor(F.col(ix) / 12).cast("string")
    parts = (("{a}", two("from_ix")), ("{b}", two("to_ix")), ("{y}", year("from_ix")), ("{z}", year("to_ix")))
    dates = pick(_ROLE_DATES, k * 7 + F.col("o_custkey"))
    for mark, value in parts:
        dates = F.replace(dates, F.lit(mark), value)
    firm = F.replace(pick(_ROLE_FIRMS, k * 5 + F.col("o_custkey")), F.lit("{n}"), F.initcap("n_name"))
    docs = t.documents.select("doc_id", F.col("lang").alias("doc_lang"), F.col("lang").alias("langs"))
    raw = (t.order_roles.join(t.nation, F.col("n_nationkey") == k % 25).join(docs, F.col("doc_id") == F.col("o_custkey"))
           .select("doc_id", "doc_lang", "langs", k.alias("role_ix"), pick(_ROLE_TITLES, k * 11 + F.col("o_custkey")).alias("title"), firm.alias("employer"), dates.alias("dates"),
                   F.col("n_lines"), dt.parse_range(dates).alias("pd")))
    early, late = dt.early_ix(F.col("pd.from"), TODAY), dt.late_ix(F.col("pd.to"), TODAY)
    sized = raw.select("*", early.alias("from_ix"), late.alias("to_ix"), F.coalesce(F.col("pd.to.is_open"), F.lit(False)).alias("is_current"), F.coalesce(F.col("pd.from.fmt"), F.lit("")).alias("fmt"))
    counts = sized.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_roles"))
    return worked_out_once(iv.recency_rank(sized, "doc_id", "role_ix").join(counts, "doc_id"), "doc_id", "role_ix")


@query("lint_all_with_roles")
def _(t):
    """Every check with a data rule, roles and places given. The families over documents and lines have their SQL in ``lint_all``; a test names the
    checks that must fire."""
    alias = t.spark.createDataFrame([("dubai", "uae", None), ("emirates", "uae", None), ("paris", "france", None), ("france", "france", None), ("gulf", None, "gcc")],
                                    "place string, country string, meta string")
    members = t.spark.createDataFrame([("gcc", "uae"), ("gcc", "qatar")], "meta string, country string")
    docs = profile(t).withColumn("summary", F.when(F.col("doc_id") % 9 == 0, F.concat("summary", F.lit(" Offices in Dubai and Paris."))).otherwise(F.col("summary")))
    docs = docs.withColumn("headline", F.when(F.col("doc_id") % 8 == 0, F.concat("headline", F.lit(" Managing Director"))).otherwise(F.col("headline")))
    return li.lint_all(docs, bullets(t), roles_of_documents(t), words=WORDS, title_words=TITLES, company_openers=COMPANY, places=_PLACES, alias=alias, members=members, today_ix=TODAY, **DIAL)
