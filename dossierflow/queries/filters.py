"""Row filters."""
from pyspark.sql import functions as F

from dossierflow.catalog import query
from dossierflow.functions import contacts as ct
from dossierflow.functions import html as hx
from dossierflow.functions import text as tx
from dossierflow.functions.text import q_has_term, q_str
from dossierflow.operators import filters as fl

BOARDS = ["exampleboard", "jobsite"]
ROLES = [("red plate", ["red plate", "blue plate"]), ("economy ring", []), ("small bolt", ["small bolt", "tiny bolt"]), ("gear of large", [])]
JUNIOR = ("widget",)
JUNK_HOST = r"^mail[1-3]\.example\.com$"


@query("c1_clean_title", rf"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(raw, '(?i)\s*[|–—•-]\s*(?:exampleboard|jobsite).*$', ''),
  '(?i)(?:^|\s)(?:jobs?|vacancy|vacancies|hiring|careers?)\s+in\s+[a-z\s,]+$', ''), '^\s+|\s+$', '', 'g') AS title
FROM (SELECT page_id, {hx.q_first_tag('html', 'title')} || CASE WHEN page_id % 2 = 0 THEN ' jobs in example town' ELSE ' | JobSite today' END AS raw FROM pages)""")
def _(t):
    raw = F.concat(hx.first_tag("html", "title"), F.when(F.col("page_id") % 2 == 0, " jobs in example town").otherwise(" | JobSite today"))
    return t.pages.select("page_id", fl.clean_title(raw, BOARDS).alias("title"))


@query("c2_strict_role_match", """SELECT p_partkey, CASE WHEN contains(p, ' widget ') THEN NULL
  WHEN contains(p, ' red plate ') OR contains(p, ' blue plate ') THEN 'red plate'
  WHEN contains(p, ' economy ring ') OR ((contains(p, ' economy ') OR contains(p, ' economys ')) AND (contains(p, ' ring ') OR contains(p, ' rings '))) THEN 'economy ring'
  WHEN contains(p, ' small bolt ') OR contains(p, ' tiny bolt ') OR (contains(p, ' small ') AND contains(p, ' bolt ')) THEN 'small bolt'
  WHEN contains(p, ' gear of large ') OR (contains(p, ' gear ') AND contains(p, ' large ')) THEN 'gear of large' END AS role
FROM (SELECT p_partkey, ' ' || lower(p_name || ' ' || p_type) || ' ' AS p FROM part)""")
def _(t):
    title = F.concat_ws(" ", "p_name", "p_type")
    return t.part.select("p_partkey", fl.strict_role(title, ROLES, JUNIOR).alias("role"))


@query("c3_loose_role_match", r"""SELECT doc_id FROM (SELECT doc_id, ' ' || regexp_replace(lower(text), '[^\p{L}\p{N}&]+', ' ', 'g') || ' ' AS p FROM documents)
WHERE contains(p, ' thention')::INT + contains(p, ' eron')::INT + contains(p, ' lyand')::INT >= 2""")
def _(t):
    return t.documents.where(fl.loose_role("text", "thention of eron lyand")).select("doc_id")


@query("c4_senior_only", """SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'plate') OR contains(p_name, 'large')""")
def _(t):
    keep = fl.senior_only(t.part, "p_name", ("plate", "large"))
    return fl.drop_lower_rung(keep, "p_name").select("p_partkey", "p_name")


@query("c5_language_gate", """SELECT doc_id, lang FROM documents WHERE NOT regexp_matches(text, '[äöüßéèñ]') OR lang IN ('de', 'es')""")
def _(t):
    allowed = t.documents.where("lang IN ('de', 'es')").select("lang")
    return fl.language_gate(t.documents, F.col("text").rlike("[äöüßéèñ]"), "lang", allowed).select("doc_id", "lang")


@query("c6_region_gate", """SELECT c_custkey, CASE WHEN contains(lower(title || ' ' || n_name), 'nation_7') THEN 'nation_7'
  WHEN contains(lower(title || ' ' || n_name), 'europe') OR contains(lower(title || ' ' || n_name), 'middle east') THEN 'wanted region'
  WHEN c_custkey % 2 = 0 THEN 'host' ELSE '' END AS region
FROM (SELECT c_custkey, n_name, c_mktsegment || ' ' || r_name AS title FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
WHERE NOT (title LIKE '% ASIA' AND NOT contains(lower(title || ' ' || n_name), 'nation_7'))""")
def _(t):
    geo = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    df = fl.join_small(t.customer, geo, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "n_name", F.concat_ws(" ", "c_mktsegment", "r_name").alias("title"),
        F.when(F.col("c_custkey") % 2 == 0, "www.shop.ae").otherwise("www.shop.com").alias("host"))
    return fl.region_gate(df, "title", "n_name", "host", "nation_7", ["asia"], ["europe", "middle east"], r"\.ae$", "wanted region").select("c_custkey", "region")


@query("c7_quarantine_invalid", r"""SELECT c_custkey, array_to_string(list_filter([CASE WHEN NOT regexp_matches(c_name, '^Customer#[0-9]{9}$') THEN 'id' END,
  CASE WHEN c_acctbal < 0 THEN 'balance' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'segment' END], lambda x: x IS NOT NULL), ',') AS errors,
  NOT (c_acctbal < 0) AND regexp_matches(c_name, '^Customer#[0-9]{9}$') AS kept FROM customer""")
def _(t):
    rules = {"id": F.col("c_name").rlike(r"^Customer#[0-9]{9}$"), "balance": F.col("c_acctbal") >= 0,
             "segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD")}
    return fl.quarantine(t.customer, rules, {"id", "balance"}).select("c_custkey", F.array_join("errors", ",").alias("errors"), "kept")


@query("c9_email_filter", f"""SELECT doc_id, email FROM (SELECT doc_id, unnest({ct.q_emails('text')}) AS email FROM documents) WHERE {ct.q_usable('email', JUNK_HOST)}""")
def _(t):
    return fl.email_filter(t.documents, "text", JUNK_HOST).select("doc_id", "email")


@query("c11_region_split", f"SELECT c_custkey, {q_has_term('n_name', ('nation_1', 'nation_2'))} AS inside FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    j = fl.join_small(t.customer, t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select("c_custkey", tx.has_term("n_name", ("nation_1", "nation_2")).alias("inside"))


@query("c12_audience_filter", """SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM (
  SELECT DISTINCT source, CASE WHEN length(source) = 4 THEN 'gulf' ELSE 'dach' END AS market, CASE WHEN ends_with(source, '3') THEN 'de' WHEN ends_with(source, '5') THEN 'fr' ELSE '' END AS lang FROM documents)
  WHERE market = 'gulf' AND lang IN ('', 'de'))""")
def _(t):
    audience = t.documents.select("source").distinct().select(
        "source", F.when(F.length("source") == 4, "gulf").otherwise("dach").alias("market"),
        F.when(F.col("source").endswith("3"), "de").when(F.col("source").endswith("5"), "fr").otherwise("").alias("lang"))
    return fl.audience_filter(t.documents, audience, ["gulf"], ["de"]).select("doc_id", "source")
