"""String, pattern, array and map functions over the given tables."""
from pyspark.sql import functions as F

from dossierflow.catalog import query
from dossierflow.functions import contacts as ct
from dossierflow.functions import mailboxes as mb
from dossierflow.functions import profiles as pf
from dossierflow.functions import text as tx
from dossierflow.functions import titles as tt
from dossierflow.functions.text import q_has_term, q_list, q_str
from dossierflow.operators import merge as mg
from dossierflow.operators import personal as ps
from dossierflow.operators import postings as po
from dossierflow.operators.scale import join_small
from dossierflow.plans import catalogue as cat
from dossierflow.plans import lint as li
from dossierflow.tables import Q_PARAGRAPHS

# Headings and cues made of words that occur in the given documents.
REQ = r"(?i)^(?:the|der|le|la)(?:[^\p{L}]|$)"
OTHER = r"(?i)^(?:of|und|les|de)(?:[^\p{L}]|$)"


_UNBULLET = r"regexp_replace(l, '^[\s•–—*·▪●◦-]+', '')"


@query("s1_normalize", f"SELECT doc_id, md5({tx.q_norm('text')}) AS norm_key, md5(' ' || {tx.q_norm('text')} || ' ') AS padded_key FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(tx.norm("text")).alias("norm_key"), F.md5(tx.padded("text")).alias("padded_key"))


@query("s2_whole_word", f"SELECT doc_id, {q_has_term('text', ('the', 'of the', 'für', 'été'))} AS found FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.has_term("text", ("the", "of the", "für", "été")).alias("found"))


@query("s3_stem", f"SELECT stem, count(*) AS n FROM (SELECT {tx.q_stem('w')} AS stem FROM (SELECT unnest({tx.q_words('text')}) AS w FROM documents)) GROUP BY 1")
def _(t):
    return t.documents.select(F.explode(tx.words("text")).alias("w")).groupBy(tx.stem("w").alias("stem")).agg(F.count(F.lit(1)).alias("n"))


@query("s4_sentences", f"SELECT doc_id, (ix - 1)::INT AS sent_ix, s AS sentence FROM documents, unnest({tx.q_sentences('text')}) WITH ORDINALITY AS u(s, ix)")
def _(t):
    return t.sentences.select("doc_id", "sent_ix", "sentence")


@query("s5_prepared_lines", rf"""WITH r AS (SELECT doc_id, ix, {tx.q_squeeze(_UNBULLET)} AS l FROM documents, unnest(string_split(replace(text, chr(13), ''), chr(10))) WITH ORDINALITY AS u(l, ix)),
k AS (SELECT doc_id, ix, CASE WHEN regexp_matches(l, {q_str(po.NOISE_LINE)}) OR regexp_matches(l, {q_str(po.AGE_LINE)}) THEN '' ELSE l END AS l FROM r),
g AS (SELECT *, lag(l) OVER (PARTITION BY doc_id ORDER BY ix) AS p FROM k),
f AS (SELECT *, CASE WHEN coalesce(p, '') <> '' AND NOT regexp_matches(p, '[.!?:;]$') AND NOT regexp_matches(p, {q_str(REQ)}) AND (regexp_matches(l, '^[a-zäöüß(]') OR regexp_matches(p, {q_str(po.CONTINUES)})) THEN 0 ELSE 1 END AS st FROM g WHERE l <> ''),
i AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY ix) AS isl FROM f)
SELECT doc_id, (isl - 1)::INT AS line_ix, string_agg(l, ' ' ORDER BY ix) AS line FROM i GROUP BY doc_id, isl""")
def _(t):
    """Headings never match a joined line here, so the check may test the raw line above."""
    return t.documents.select("doc_id", F.posexplode(po.prepared_lines("text", heading=REQ)).alias("line_ix", "line"))


@query("s6_sections", f"""WITH {Q_PARAGRAPHS}, h AS (SELECT doc_id, line_ix, line, CASE WHEN regexp_matches(line, {q_str(REQ)}) THEN 'req' WHEN regexp_matches(line, {q_str(OTHER)}) THEN 'other' END AS h FROM paragraphs)
SELECT doc_id, line_ix, section FROM (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM h) WHERE h IS NULL""")
def _(t):
    return po.sections(t.paragraphs.select("doc_id", "line_ix", "line"), "doc_id", "line_ix", "line", REQ, OTHER).select("doc_id", "line_ix", "section")


_POSTING = """'We are looking for someone with ' || (o_orderkey % 12 + 1)::VARCHAR || ' years of experience in ' || lower(c_mktsegment) || ', fluent German and a degree in logistics; basic Arabic would be a plus'"""


def _postings(t):
    """Orders printed as a requirement sentence of a posting."""
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    s = F.concat(F.lit("We are looking for someone with "), (F.col("o_orderkey") % 12 + 1).cast("string"), F.lit(" years of experience in "), F.lower("c_mktsegment"),
                 F.lit(", fluent German and a degree in logistics; basic Arabic would be a plus"))
    return j.select("o_orderkey", s.alias("sentence"))


@query("s7_requirement_items", """SELECT o_orderkey, i::INT AS item_ix, CASE i WHEN 0 THEN 'years' WHEN 1 THEN 'language' ELSE 'language' END AS type, CASE WHEN i = 2 THEN 'nice' ELSE 'must' END AS strength,
  CASE WHEN i = 0 THEN 'experience in ' || lower(c_mktsegment) ELSE '' END AS field, CASE WHEN i = 0 THEN o_orderkey % 12 + 1 END::INT AS years, CASE i WHEN 1 THEN 'german' WHEN 2 THEN 'arabic' END AS language, CASE i WHEN 1 THEN 4 WHEN 2 THEN 1 ELSE 0 END::INT AS level
FROM orders JOIN customer ON o_custkey = c_custkey, unnest([0, 1, 2]) AS u(i)""")
def _(t):
    rows = po.requirement_items(_postings(t), ["o_orderkey"], "sentence", F.lit(True))
    return rows.select("o_orderkey", "item_ix", "type", "strength", F.coalesce("field", F.lit("")).alias("field"), "years", "language", "level")


@query("s9_posting_to_verdict", """WITH p AS (SELECT o_orderkey, o_orderkey % 12 + 1 AS asked, c_custkey % 10 + 1 AS held, c_custkey % 5 AS german, c_custkey % 2 AS arabic, c_custkey % 3 <> 0 AS degree, c_mktsegment <> 'BUILDING' AS segment, o_orderkey % 50 = 0 AND c_custkey % 4 <> 1 AS other_nation, o_orderkey % 50 = 0 AS nation
  FROM orders JOIN customer ON o_custkey = c_custkey),
s AS (SELECT *, 3 + 2 + 3 + 1 + 2 + CASE WHEN nation AND NOT other_nation THEN 2 ELSE 0 END AS total, CASE WHEN held >= asked THEN 3 ELSE 0 END + CASE WHEN german >= 4 THEN 2 ELSE 0 END + CASE WHEN degree THEN 3 ELSE 0 END + CASE WHEN arabic >= 1 THEN 1 ELSE 0 END
  + CASE WHEN segment THEN 2 ELSE 0 END + CASE WHEN nation AND NOT other_nation THEN 2 ELSE 0 END AS got, held < asked OR german < 4 OR NOT degree OR NOT segment AS open FROM p),
f AS (SELECT *, ((200 * got + total) // (2 * total))::INT AS score FROM s)
SELECT o_orderkey, score, CASE WHEN other_nation OR score < 40 THEN 'skip' WHEN open THEN 'gap' ELSE 'apply' END AS verdict FROM f""")
def _(t):
    """Orders printed as whole postings, customers as persons: from the raw text to the verdict."""
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    k, n = F.col("o_orderkey"), F.col("c_custkey")
    text = F.concat(F.lit("Like\nYour responsibilities\nLead the team.\nRequirements:\n• "), (k % 12 + 1).cast("string"), F.lit(" years of experience in trade\n• Fluent German\n• Degree in logistics\n• Basic Arabic skills would be a plus\n• Planning of "),
                    F.lower("c_mktsegment"), F.when(k % 50 == 0, "\n• Omani nationals").otherwise(""), F.lit("\nWhat we offer\nA desk and German lessons."))
    items = po.parse_posting(j.select("o_orderkey", text.alias("text")), "o_orderkey", "text")
    people = j.select("o_orderkey", (n % 10 + 1).cast("int").alias("years_held"), F.when(n % 4 == 1, "Omani").otherwise("Other").alias("nationality"), (n % 3 != 0).alias("has_degree"))
    tokens = j.select("o_orderkey", F.explode(F.array(F.lit("planned"), F.lit("planning"), F.when(F.col("c_mktsegment") != "BUILDING", F.lower("c_mktsegment")).otherwise("none"))).alias("token"))
    langs = j.select("o_orderkey", F.explode(F.array(F.struct(F.lit("german").alias("language"), (n % 5).cast("int").alias("held")), F.struct(F.lit("arabic").alias("language"), (n % 2).cast("int").alias("held")))).alias("l")).select("o_orderkey", "l.*")
    return po.assess_fit(items, "o_orderkey", people, tokens, langs)


@query("s8_instructions", f"""WITH s AS (SELECT doc_id, ix, s FROM documents, unnest({tx.q_sentences('text')}) WITH ORDINALITY AS u(s, ix)),
k AS (SELECT doc_id, 'salary' AS kind, min(ix) AS ix FROM s WHERE regexp_matches(s, 'tion') AND regexp_matches(s, 'the') GROUP BY 1 UNION ALL SELECT doc_id, 'reference', min(ix) FROM s WHERE regexp_matches(s, 'ment') GROUP BY 1)
SELECT doc_id, kind, (ix - 1)::INT AS sent_ix FROM k""")
def _(t):
    rules = (("salary", "tion"), ("reference", "ment"))
    return po.instruction_rows(t.sentences, "doc_id", "sent_ix", "sentence", rules, "the").select("doc_id", "kind", "sent_ix")


@query("s9_find_fields", rf"""SELECT doc_id, coalesce(list_filter(ls, lambda l: length(l) <= 140 AND regexp_matches(l, '(?i)tion') AND NOT regexp_matches(l, '[.!?]$') AND NOT contains(l, ':'))[1], '') AS title,
  CASE WHEN strpos(n, ' thou ') > 0 AND (strpos(n, ' thou ') < strpos(n, ' hein ') OR strpos(n, ' hein ') = 0) THEN 'thou' WHEN strpos(n, ' hein ') > 0 THEN 'hein' WHEN strpos(n, ' und ') > 0 THEN 'und' ELSE '' END AS city,
  (doc_id % 28 + 1)::VARCHAR || ' March 2026' AS start_date, (doc_id % 28 + 1)::VARCHAR || '.10.2025' AS posted FROM (SELECT doc_id, {tx.q_lines('text')} AS ls, ' ' || {tx.q_norm('text')} || ' ' AS n FROM documents)""")
def _(t):
    day = (F.col("doc_id") % 28 + 1).cast("string")
    tail = F.concat(F.lit(" Start date: "), day, F.lit(" March 2026. Published: "), day, F.lit(".10.2025"))
    return t.documents.select("doc_id", po.find_title(tx.lines("text"), "(?!)", "(?i)tion").alias("title"), po.find_place("text", ["thou", "hein", "und"], ["und"]).alias("city"),
                              po.find_start(tail).alias("start_date"), po.find_posted(tail).alias("posted"))


@query("c8_looks_like_listing", rf"""SELECT doc_id, title <> '' OR needs AS listing FROM (SELECT doc_id, coalesce(list_filter({tx.q_lines('text')}, lambda l: length(l) <= 140 AND regexp_matches(l, '(?i)tion') AND NOT regexp_matches(l, '[.!?]$') AND NOT contains(l, ':'))[1], '') AS title, regexp_matches(text, 'lyand|aux') AS needs FROM documents)""")
def _(t):
    title = po.find_title(tx.lines("text"), "(?!)", "(?i)tion")
    return t.documents.select("doc_id", ((title != "") | F.col("text").rlike("lyand|aux")).alias("listing"))


@query("s10_language_vote", f"SELECT doc_id, {tx.q_lang_from_votes()} AS voted FROM (SELECT doc_id, {', '.join(f'{tx.q_votes(chr(116) + chr(101) + chr(120) + chr(116), k)} AS v_{k}' for k in tx.STOPWORDS)} FROM documents)")
def _(t):
    return t.documents.select("doc_id", tx.lang_of("text").alias("voted"))


@query("s11_has_figure", f"WITH {Q_PARAGRAPHS} SELECT doc_id, line_ix, {tx.q_has_figure('line')} AS figure FROM paragraphs")
def _(t):
    return t.paragraphs.select("doc_id", "line_ix", tx.has_figure("line").alias("figure"))


@query("s12_years_claims", "SELECT o_orderkey, array_to_string(list_sort([o_orderkey % 40 + 1, 20, 12, 25]), ',') AS claims FROM orders")
def _(t):
    s = F.concat(F.lit("More than "), (F.col("o_orderkey") % 40 + 1).cast("string"), F.lit("+ years, two decades in trade, zwölf Jahre Handel, a quarter of a century in total"))
    return t.orders.select("o_orderkey", F.array_join(F.array_sort(pf.years_claims(s)), ",").alias("claims"))


@query("s13_fold_digits", "SELECT o_orderkey, o_orderkey::VARCHAR AS folded FROM orders")
def _(t):
    """Order keys written in Arabic-Indic digits and folded back."""
    return t.orders.select("o_orderkey", tx.fold_digits(F.translate(F.col("o_orderkey").cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")).alias("folded"))


@query("s14_clean_role_title", """SELECT p_partkey, upper(left(split_part(p_name, ' ', 1), 1)) || substring(split_part(p_name, ' ', 1), 2) || ' Manager ' || lower(p_type) AS title,
  CASE WHEN p_partkey % 2 = 0 THEN 'Regional Operations and Commercial Planning' ELSE '' END AS context, 'UAE Nationals,Bilingual' AS qualifiers FROM part""")
def _(t):
    """Part names decorated like board titles; every second one too long for a headline."""
    name = F.concat(F.initcap(F.split("p_name", " ")[0]), F.lit(" Manager "), F.lower("p_type"))
    raw = F.concat(F.lit("URGENT HIRING "), name, F.when(F.col("p_partkey") % 2 == 0, " – Regional Operations and Commercial Planning").otherwise(""),
                   F.lit(" (m/w/d) UAE Nationals Bilingual - "), "p_brand", F.lit(" | Dubai"))
    r = t.part.select("p_partkey", tt.clean_role_title(raw, "p_brand", F.lit("Dubai")).alias("r"))
    return r.select("p_partkey", "r.title", "r.context", F.array_join("r.qualifiers", ",").alias("qualifiers"))


@query("s15_poster_kind", """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'agency' WHEN 2 THEN 'nameless' WHEN 3 THEN 'agency' ELSE 'employer' END AS kind,
  CASE c_custkey % 5 WHEN 1 THEN c_name WHEN 3 THEN c_name || ' Recruitment' WHEN 4 THEN c_name ELSE '' END AS name FROM customer""")
def _(t):
    k = F.col("c_custkey") % 5
    company = (F.when(k == 0, "").when(k == 1, F.concat(F.lit("via "), "c_name", F.lit(" — The Headhunter"))).when(k == 2, "via example.com")
               .when(k == 3, F.concat("c_name", F.lit(" Recruitment"))).otherwise(F.col("c_name")))
    return t.customer.select("c_custkey", tt.poster(company).alias("p")).select("c_custkey", "p.kind", "p.name")


LADDER = (("top", ("large", "old plate")), ("middle", ("hot", "red")), ("low", ("small",)))


@query("s16_seniority", f"SELECT p_partkey, CASE WHEN {q_has_term('p_name', LADDER[0][1])} THEN 'top' WHEN {q_has_term('p_name', LADDER[1][1])} THEN 'middle' WHEN {q_has_term('p_name', LADDER[2][1])} THEN 'low' WHEN p_size >= 6 THEN 'senior' WHEN p_size >= 3 THEN 'mid' ELSE 'junior' END AS level FROM part")
def _(t):
    return t.part.select("p_partkey", tt.seniority("p_name", "p_size", LADDER).alias("level"))


_HELD = ("Group Managing Director", "Vice President Sales", "Head of Retail", "Account Manager", "Senior Analyst", "Legal Counsel")
_HELD_FAMILY = ("exec", "vp", "head", "manager", "staff", None)
_WANTED = ("Sales Director", "Team Lead", "Trainee", "Co-Founder", "Compliance Officer")
_WANTED_FAMILY = ("director", "manager", "entry", "owner", "officer")
_PAIRS = [(k, a, b, "NULL" if a is None else "'same'" if a == b else "'near'" if (a, b) in cat.NEAR_PAIRS or (b, a) in cat.NEAR_PAIRS else "'far'")
          for k in range(30) for a, b in [(_HELD_FAMILY[k % 6], _WANTED_FAMILY[k // 6])]]


@query("s17_title_family", "SELECT o_orderkey, CASE o_orderkey % 30 " + " ".join(f"WHEN {k} THEN {'NULL' if a is None else q_str(a)}" for k, a, _, _ in _PAIRS) + " END AS held, CASE o_orderkey % 30 "
       + " ".join(f"WHEN {k} THEN {q_str(b)}" for k, _, b, _ in _PAIRS) + " END AS wanted, CASE o_orderkey % 30 " + " ".join(f"WHEN {k} THEN {r}" for k, _, _, r in _PAIRS) + " END AS relation FROM orders")
def _(t):
    """Held and wanted titles in all combinations, by order."""
    k = F.col("o_orderkey") % 30
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))
    rows = t.orders.select("o_orderkey", li.title_family(pick(_HELD, k % 6)).alias("held"), li.title_family(pick(_WANTED, F.floor(k / 6))).alias("wanted"))
    return rows.withColumn("relation", li.family_relation(F.col("held"), F.col("wanted")))


@query("s18_mailbox_kind", """SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'apply' WHEN 1 THEN 'never' WHEN 2 THEN 'general' WHEN 3 THEN 'apply' WHEN 4 THEN 'general' ELSE 'apply' END AS kind FROM supplier""")
def _(t):
    k = F.col("s_suppkey") % 6
    local = (F.when(k == 0, "jobs.dubai").when(k == 1, "sales24").when(k == 2, "jordan.sales").when(k == 3, "hrdubai").when(k == 4, "maria").otherwise("acmejobs"))
    return t.supplier.select("s_suppkey", mb.mailbox_kind(F.concat(local, F.lit("@acme.com"))).alias("kind"))


@query("s19_clean_address", "SELECT s_suppkey, 'hr' || s_suppkey::VARCHAR || '@acme.ae' AS address FROM supplier")
def _(t):
    raw = F.concat(F.lit("hr"), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, "@acme.ae.For").otherwise("@acme.ae."))
    return t.supplier.select("s_suppkey", mb.clean_address(raw).alias("address"))


@query("s20_addresses_near_request", """SELECT s_suppkey, 'jobs@acme.ae' AS address, true AS asks FROM supplier UNION ALL SELECT s_suppkey, 'info' || s_suppkey::VARCHAR || '@acme.ae', s_suppkey % 2 = 0 FROM supplier""")
def _(t):
    key = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("Please send your CV. Write to jobs@acme.ae today. "), F.when(F.col("s_suppkey") % 2 == 0, "Your application goes to info").otherwise("For questions write to info"), key, F.lit("@acme.ae. Not for us: sales@acme.ae."))
    rows = t.supplier.select("s_suppkey", F.explode(mb.near_request(text)).alias("r"))
    return rows.select("s_suppkey", "r.address", "r.asks")


@query("s21_phones", r"""WITH runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:tel:)?(?:\+|(?:^|[^0-9])00)[0-9](?:[0-9().\x2f \t-]*[0-9])?')) AS raw FROM documents),
r AS (SELECT doc_id, regexp_replace(raw, '^(?:tel:|[^0-9+]+)+', '') AS r FROM runs),
parts AS (SELECT doc_id, unnest(CASE WHEN length(regexp_replace(regexp_replace(r, '^(?:\+|00)', ''), '[^0-9]', '', 'g')) > 15 THEN regexp_split_to_array(r, '\s+/\s+') ELSE [r] END) AS p FROM r),
good AS (SELECT doc_id, trim(regexp_replace(p, '\s+', ' ', 'g')) AS p FROM parts),
d AS (SELECT doc_id, p, regexp_replace(regexp_replace(p, '^(?:\+|00)', ''), '[^0-9]', '', 'g') AS digits FROM good WHERE regexp_matches(p, '^(?:\+|00)[0-9]')),
one AS (SELECT doc_id, digits, list_sort(list(DISTINCT p)) AS ps FROM d WHERE length(digits) BETWEEN 8 AND 15 GROUP BY 1, 2)
SELECT documents.doc_id, coalesce(string_agg(ps[1], '|' ORDER BY ps[1]), '') AS phones FROM documents LEFT JOIN one USING (doc_id) GROUP BY 1""")
def _(t):
    return t.documents.select("doc_id", F.array_join(F.array_sort(ct.phones("text")), "|").alias("phones"))


@query("s22_split_skills", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || '|' || lower(p_type) || '|' || p_brand WHEN p_partkey % 3 = 1 THEN p_name || '|ERP/SAP|' || p_brand ELSE p_name || ', planning and ' || lower(p_type) END AS items FROM part""")
def _(t):
    k = F.col("p_partkey") % 3
    line = (F.when(k == 0, F.concat("p_name", F.lit(", "), F.lower("p_type"), F.lit(", "), "p_brand", F.lit(".")))
            .when(k == 1, F.concat("p_name", F.lit(" • ERP/SAP; "), "p_brand")).otherwise(F.concat("p_name", F.lit(", planning and "), F.lower("p_type"))))
    return t.part.select("p_partkey", F.array_join(pf.split_skills(line), "|").alias("items"))


@query("s27_localized_label", "SELECT doc_id, CASE lang WHEN 'de' THEN 'Quelle' WHEN 'fr' THEN 'Source (fr)' ELSE 'Source' END AS label FROM documents")
def _(t):
    table = {("src", "en"): "Source", ("src", "de"): "Quelle", ("src", "fr"): "Source (fr)"}
    return t.documents.select("doc_id", pf.localized(F.lit("src"), table, "lang").alias("label"))


@query("s28_path_lookup", f"WITH {Q_PARAGRAPHS} SELECT doc_id, 'lines.' || line_ix::VARCHAR AS path, md5(line) AS value_key FROM paragraphs WHERE line_ix = doc_id % 5")
def _(t):
    """Values of stored paths: the paths of a document joined to its exploded (path, value) rows."""
    values = t.paragraphs.select("doc_id", F.concat(F.lit("lines."), F.col("line_ix").cast("string")).alias("path"), F.md5("line").alias("value_key"))
    asked = t.documents.select("doc_id", F.concat(F.lit("lines."), (F.col("doc_id") % 5).cast("string")).alias("path"))
    return mg.values_at(values, asked, ["doc_id", "path"])


@query("s29_term_at", r"""SELECT doc_id, (strpos(f, ' thou') - 1)::INT AS word_start, (strpos(f, ' an ') - 1)::INT AS whole FROM (SELECT doc_id, ' ' || regexp_replace(lower(text), '[^\p{L}\p{N}&-]', ' ', 'g') || ' ' AS f FROM documents)""")
def _(t):
    return t.documents.select("doc_id", pf.term_at("text", F.lit("thou")).alias("word_start"), pf.term_at("text", F.lit("an")).alias("whole"))


@query("s31_word_stats", f"SELECT doc_id, {tx.q_word_count('text')}::INT AS n_words, len({tx.q_sentences('text')})::INT AS n_sentences, len({tx.q_lines('text')})::INT AS n_lines FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.word_count("text").alias("n_words"), F.size(tx.sentences("text")).alias("n_sentences"), F.size(tx.lines("text")).alias("n_lines"))


@query("s32_language_rows", """SELECT p_partkey, name, code, level, cefr FROM part, (VALUES ('German', 'de', 5, ''), ('English', 'en', NULL, 'C1'), ('Klingon', NULL, NULL, '')) v(name, code, level, cefr) WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, 'Arabic', 'ar', 2, '' FROM part WHERE p_partkey % 2 = 1""")
def _(t):
    line = F.when(F.col("p_partkey") % 2 == 0, "German (native) · English: C1 | Klingon").otherwise("Arabic – good")
    return t.part.select("p_partkey", F.explode(pf.language_rows(line)).alias("r")).select("p_partkey", "r.name", "r.code", "r.level", "r.cefr")


@query("s33_answer_needs_unit", "SELECT l_orderkey, l_linenumber, l_linenumber % 4 IN (0, 3) AS needs FROM lineitem")
def _(t):
    n = F.col("l_quantity").cast("int").cast("string")
    answer = (F.when(F.col("l_linenumber") % 4 == 0, n).when(F.col("l_linenumber") % 4 == 1, F.concat(n, F.lit(" staff")))
              .when(F.col("l_linenumber") % 4 == 2, F.concat(F.lit("AED "), n)).otherwise(F.concat(F.lit("more than "), n, F.lit("m"))))
    return t.lineitem.select("l_orderkey", "l_linenumber", pf.answer_needs_unit(answer).alias("needs"))


@query("s34_required_language", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'arabic' WHEN 1 THEN 'german' WHEN 2 THEN 'english' WHEN 3 THEN 'french' ELSE 'german' END AS lang FROM customer")
def _(t):
    k = F.col("c_custkey") % 5
    text = (F.when(k == 0, "Fluent Arabic and English required.").when(k == 1, "Business-level German is essential.").when(k == 2, "Expand into the Chinese market. Home English Jobs")
            .when(k == 3, "Native French speaker.").otherwise("Ihre Aufgaben: Leitung"))
    title = F.when(k == 4, F.concat("c_mktsegment", F.lit(" lead (m/w/d)"))).otherwise(F.col("c_mktsegment"))
    return t.customer.select("c_custkey", tt.required_language(title, text).alias("lang"))


@query("s35_role_queries", """SELECT c_custkey, '"' || lower(c_mktsegment) || ' lead" jobs in ' || n_name || ';"head of ' || lower(c_mktsegment) || '" jobs in ' || n_name AS queries FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def _(t):
    j = join_small(t.customer, t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    roles = F.array(F.concat("c_mktsegment", F.lit(" Lead!")), F.concat(F.lit("Head of "), "c_mktsegment"), F.concat("c_mktsegment", F.lit("  LEAD")))
    return j.select("c_custkey", F.array_join(tt.role_queries(roles, F.col("n_name")), ";").alias("queries"))


# ---- the same functions over whole texts of the given tables

_UNIT = "(?:years?|yrs|jahren?|ans|années|años|anni)"
_NUMBERS = "MAP {" + ", ".join(f"{q_str(w)}: {n}" for w, n in tx.SPELLED_NUMBERS.items()) + "}"
_TEXTS = """(SELECT 'd' AS src, doc_id AS id, 0 AS turn, text FROM documents UNION ALL SELECT 'c', conv_id, turn, text FROM conversations UNION ALL SELECT 'p', page_id, 0, html FROM pages)"""


def all_texts(t):
    """Texts of documents, conversations and pages: ``src, id, turn, text``."""
    one = lambda df, src, key, turn, text: df.select(F.lit(src).alias("src"), F.col(key).cast("long").alias("id"), turn.cast("int").alias("turn"), F.col(text).alias("text"))
    return one(t.documents, "d", "doc_id", F.lit(0), "text").unionByName(one(t.conversations, "c", "conv_id", F.col("turn"), "text")).unionByName(
        one(t.pages, "p", "page_id", F.lit(0), "html"))


@query("s12_years_claims_texts", rf"""SELECT src, id::BIGINT AS id, turn::INT AS turn, array_to_string(list_sort(list_filter(list_concat(list_concat(
  list_transform(regexp_extract_all(t, '([0-9]{{1,2}})\s*\+?\s*{_UNIT}(?:[^\p{{L}}]|$)', 1), lambda d: d::INT),
  list_transform(regexp_extract_all(t, '(\p{{L}}+)\s+{_UNIT}(?:[^\p{{L}}]|$)', 1), lambda w: {_NUMBERS}[w]::INT)),
  CASE WHEN regexp_matches(t, 'quarter(?:\s+of\s+a)?\s+century|vierteljahrhundert') THEN [25] ELSE [] END), lambda n: n > 0)), ',') AS claims
FROM (SELECT src, id, turn, lower(text) AS t FROM {_TEXTS})""")
def _(t):
    return all_texts(t).select("src", "id", "turn", F.array_join(F.array_sort(pf.years_claims("text")), ",").alias("claims"))


_ADDRESS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def printed_addresses(t):
    """Every printed address, and in documents a made-up department box per source beside it: ``src, id, raw``."""
    found = all_texts(t).select("src", "id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_ADDRESS), F.lit(0)))).alias("raw"))
    words = sorted(mb.VOCABULARY)
    pick = lambda k: F.element_at(F.array(*map(F.lit, words)), (k % len(words) + 1).cast("int"))
    k = F.col("doc_id")
    glue = F.element_at(F.array(*map(F.lit, ("", ".", "-", "24", "x"))), (k % 5 + 1).cast("int"))
    made = t.documents.select(F.lit("m").alias("src"), k.alias("id"), F.concat(pick(k * 7), glue, pick(k * 13 + 5), F.lit("@"), "source", F.lit(".com"), F.when(k % 3 == 0, ".For").otherwise("")).alias("raw"))
    return found.unionByName(made)


_MADE = f"list_sort([{', '.join(q_str(w) for w in sorted(mb.VOCABULARY))}])"
Q_ADDRESSES = rf"""words AS (SELECT {_MADE} AS ws), printed AS (SELECT DISTINCT src, id::BIGINT AS id, unnest(regexp_extract_all(text, '{_ADDRESS}')) AS raw FROM {_TEXTS}
  UNION ALL SELECT 'm', doc_id, ws[(doc_id * 7) % len(ws) + 1] || (['', '.', '-', '24', 'x'])[doc_id % 5 + 1] || ws[(doc_id * 13 + 5) % len(ws) + 1] || '@' || source || '.com' || CASE WHEN doc_id % 3 = 0 THEN '.For' ELSE '' END FROM documents, words),
clean AS (SELECT src, id, raw, lower(CASE WHEN regexp_matches(a, '^[^@A-Z]+@[^@A-Z]+\.[a-z]{{2,}}\.[A-Z][a-z]+$') THEN regexp_replace(a, '\.[A-Z][a-z]+$', '') ELSE a END) AS address
  FROM (SELECT *, regexp_replace(raw, '[.,;:)\]]+$', '') AS a FROM printed))""".replace("\\\\", "\\")


@query("s19_clean_addresses_texts", f"WITH {Q_ADDRESSES} SELECT src, id, raw, address FROM clean")
def _(t):
    return printed_addresses(t).select("src", "id", "raw", mb.clean_address("raw").alias("address"))


@query("s18_mailbox_kinds_texts")
def _(t):
    """Kind of every printed address; no SQL twin of the word break, a test compares it with plain loops."""
    return printed_addresses(t).select("src", "id", "raw", mb.mailbox_kind(mb.clean_address("raw")).alias("kind"))


@query("s34_required_language_texts", "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(hay, {q_str(tt.demand_for(x))}) THEN '{x}'" for x in tt.LANGUAGE_CUES)
       + f" WHEN regexp_matches(title, {q_str(tt.GERMAN_AD)}) THEN 'german' ELSE 'english' END AS lang FROM (SELECT doc_id, title, lower(concat_ws(' ', title, text)) AS hay FROM (SELECT doc_id, text, coalesce({tx.q_lines('text')}[1], '') AS title FROM documents))")
def _(t):
    """Documents as ads: the first line is the title."""
    d = t.documents.select("doc_id", "text", F.coalesce(F.get(tx.lines("text"), F.lit(0)), F.lit("")).alias("title"))
    return d.select("doc_id", tt.required_language("title", F.col("text")).alias("lang"))


@query("s33_answers_texts", rf"""WITH {Q_PARAGRAPHS} SELECT doc_id, line_ix, regexp_matches(line, '[0-9]') AND NOT (regexp_matches(line, '[%€$£]') OR len(list_filter(ws, lambda w: w IN {q_list(tx.CURRENCY_WORDS)})) > 0)
  AND len(list_filter(ws, lambda w: length(w) >= 3 AND w NOT IN {q_list(pf.NOT_UNIT)} AND w NOT IN {q_list(tuple(tx.SPELLED_NUMBERS))})) = 0 AS needs FROM (SELECT doc_id, line_ix, line, regexp_split_to_array(lower(line), '[^\p{{L}}]+') AS ws FROM paragraphs)""")
def _(t):
    return t.paragraphs.select("doc_id", "line_ix", pf.answer_needs_unit("line").alias("needs"))


@query("s32_language_rows_texts", rf"""WITH {Q_PARAGRAPHS}, p AS (SELECT doc_id, line_ix, trim(raw) AS raw FROM paragraphs, unnest(regexp_split_to_array(line, '\s*[·,;|]\s*|
+')) AS u(raw) WHERE trim(raw) <> ''),
r AS (SELECT *, trim(regexp_extract(raw, '^(.+?)\s*(?:\(\s*(.*?)\s*\)|[:–—-]\s*(.+))?$', 1)) AS name, trim(regexp_extract(raw, '^(.+?)\s*(?:\(\s*(.*?)\s*\)|[:–—-]\s*(.+))?$', 2) || regexp_extract(raw, '^(.+?)\s*(?:\(\s*(.*?)\s*\)|[:–—-]\s*(.+))?$', 3)) AS lvl FROM p)
SELECT doc_id, line_ix, count(*) AS n_rows, count(*) FILTER (lower(name) IN {q_list(tuple(pf.LANGUAGE_CODES))}) AS n_known, count(*) FILTER (regexp_matches(lvl, '^(?i)[abc][12]$')) AS n_cefr FROM r GROUP BY ALL""")
def _(t):
    """Every line read as a languages line."""
    rows = t.paragraphs.select("doc_id", "line_ix", F.explode(pf.language_rows("line")).alias("r"))
    return rows.groupBy("doc_id", "line_ix").agg(F.count(F.lit(1)).alias("n_rows"), F.count("r.code").alias("n_known"), F.sum((F.col("r.cefr") != "").cast("long")).alias("n_cefr"))


@query("s30_personal_spans")
def _(t):
    """Personal details of every text; no SQL twin of the overlap sweep, tests compare it with plain loops."""
    return ps.personal_spans(all_texts(t), ["src", "id", "turn"], "text")
