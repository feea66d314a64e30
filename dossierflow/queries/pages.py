"""Pages, links and addresses."""
from pyspark.sql import functions as F

from dossierflow.catalog import query
from dossierflow.functions import html as hx
from dossierflow.functions import text as tx
from dossierflow.functions import urls as ux
from dossierflow.functions.text import q_str
from dossierflow.operators import pages as pg
from dossierflow.operators.scale import join_small

CARD = r"(?is)<li>.*?</li>"
CARD_FIELDS = {"url": r"""href=["']([^"']+)["']""", "ref": r"""href=["']/([^"']+)["']""", "title": r"(?is)>([^<]+)</a>"}
LINK_RULES = [
    pg.LinkRule("com", r"(?i)^https?://[^/]*example\.com/([a-z]{4,})$", "via com", "elsewhere", r"(?i)(tion|ment)", r"(?i)^(?:with|that|from)$"),
    pg.LinkRule("org", r"(?i)^https?://[^/]*example\.org/([a-z]{5,})$", "via org", "unknown", r"(?i)(ing|en)", r"(?i)^(?:there)$"),
]
TITLE_WORD = r"(?i)(tion|ment|ing|lich)"
SOURCES = [("spam", "spam"), ("blog.", "blog"), ("m.", "mobile"), ("example.org", "org"), ("example.net", "net")]
ATS_HOST = r"(?:^|\.)example\.net$"
CAREERS_PATH = r"(?i)/(?:the|les|die|los|and|und|[a-z]{9,})(?:/|$)"


def _title_sql():
    return ("coalesce(" + hx.q_first_tag("html", "h1") + ", nullif(regexp_split_to_array("
            + hx.q_first_tag("html", "title") + r", '\s+[|–—-]\s+')[1], ''), '')")


@query("b1_html_to_text", f"SELECT page_id, {hx.q_to_text('html')} AS body FROM pages")
def _(t):
    return t.pages.select("page_id", hx.to_text("html").alias("body"))


@query("b2_html_to_lines", f"SELECT page_id, {hx.q_to_lines('html')} AS body FROM pages")
def _(t):
    return t.pages.select("page_id", hx.to_lines("html").alias("body"))


GOOD_ANCHOR = "raw_href <> '' AND label <> '' AND NOT regexp_matches(raw_href, '(?i)^(?:#|javascript:|mailto:)')"
Q_LINKS = f"""{hx.Q_ANCHORS}, links AS (
  SELECT page_id, url, pos, label, {ux.q_resolve_root('raw_href', 'url')} AS href FROM anchors WHERE {GOOD_ANCHOR})"""


@query("b3_extract_anchors", f"WITH {Q_LINKS} SELECT page_id, pos, href, label FROM links")
def _(t):
    return pg.extract_anchors(t.pages).select("page_id", "pos", "href", "label")


@query("b4_extract_markdown_links", f"""WITH {Q_LINKS}
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1)::INT AS pos, label, href FROM (
  SELECT page_id, pos, label, regexp_replace(href, '[),.;]+$', '') AS href FROM links
  WHERE length(label) BETWEEN 4 AND 180 - 4 AND NOT regexp_matches(label, '[\\[\\]*_`]'))""")
def _(t):
    """The page's own anchors written as markdown, read back."""
    anchors = pg.extract_anchors(t.pages).where(~F.col("label").rlike(r"[\[\]*_`]") & (F.length("label") >= 4))
    item = F.concat(F.lit("[**"), F.col("label"), F.lit("**]("), F.col("href"), F.lit("#top)"))
    md = anchors.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("pos", item.alias("item")))), lambda x: x["item"]), "\n").alias("markdown"))
    return pg.extract_markdown_links(md, "markdown")


@query("b5_page_fields", f"SELECT page_id, {_title_sql()} AS title, {hx.q_to_lines('html')} AS body FROM pages")
def _(t):
    return pg.page_fields(t.pages)


@query("b6_repeating_cards", f"""
SELECT page_id, pos, url, ref, title FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, ref ORDER BY pos) AS rn FROM (
    SELECT page_id, (ix - 1)::INT AS pos, {hx.q_to_text("regexp_extract(card, " + q_str(CARD_FIELDS['url']) + ", 1)")} AS url,
           {hx.q_to_text("regexp_extract(card, " + q_str(CARD_FIELDS['ref']) + ", 1)")} AS ref,
           {hx.q_to_text("regexp_extract(card, " + q_str(CARD_FIELDS['title']) + ", 1)")} AS title
    FROM pages, unnest(regexp_extract_all(html, {q_str(CARD)})) WITH ORDINALITY AS u(card, ix))
  WHERE url <> '' AND ref <> '' AND title <> '') WHERE rn = 1""")
def _(t):
    return pg.extract_repeating_cards(t.pages, CARD, CARD_FIELDS, "ref")


def _rules_sql():
    def case(v):
        return "CASE " + " ".join(f"WHEN regexp_matches(href, {q_str(r.pattern)}) THEN {v(r)}" for r in LINK_RULES) + " END"
    return f"""WITH {Q_LINKS}
SELECT page_id, pos, source, title, ref, company, location, url FROM (
  SELECT *, row_number() OVER (PARTITION BY source, ref ORDER BY page_id, pos) AS rn FROM (
    SELECT page_id, pos, {case(lambda r: q_str(r.source))} AS source, label AS title,
      {case(lambda r: f"regexp_extract(href, {q_str(r.pattern)}, 1)")} AS ref, {case(lambda r: q_str(r.company))} AS company,
      {case(lambda r: f"coalesce(nullif(regexp_extract(label, {q_str(r.place_pattern)}, 1), ''), {q_str(r.place)})")} AS location,
      split_part(href, '?', 1) AS url, {case(lambda r: f"regexp_matches(label, {q_str(r.skip)})")} AS skip
    FROM links) WHERE source IS NOT NULL AND length(title) BETWEEN 4 AND 160 AND NOT skip) WHERE rn = 1"""


@query("b7_link_rules", _rules_sql())
def _(t):
    return pg.extract_by_link_rules(pg.extract_anchors(t.pages), LINK_RULES)


@query("b8_navigation_filter", f"""WITH {Q_LINKS}
SELECT page_id, pos, href, label AS title, 'page' AS kind FROM links
WHERE NOT regexp_matches(label, {q_str(pg.MENU_LABEL)})
  AND (regexp_matches(label, {q_str(pg.GENDER_TAG)}) OR regexp_matches(label, {q_str(TITLE_WORD)})) AND length(label) BETWEEN 9 AND 159""")
def _(t):
    """Every label is wrapped as a document link would be, and unwrapped by the operator."""
    a = pg.extract_anchors(t.pages).withColumn("label", F.concat(
        F.lit("Filetype: pdf "), F.col("label"), F.lit(" Filesize: 217.30 kb")))
    return pg.filter_navigation_links(a, TITLE_WORD).select("page_id", "pos", "href", "title", "kind")


LABELS = [("place", "Place of work"), ("workload", "Workload"), ("contract", "Contract type")]


@query("b9_labelled_run", """
SELECT c_custkey, (c_custkey % 9 + 1)::VARCHAR || ' weeks ago' AS age, c_mktsegment || ' lead' AS title, n_name AS place,
       (c_custkey % 10 * 10 + 10)::VARCHAR || '%' AS workload, 'Permanent position' AS contract, c_name AS company
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def _(t):
    """Customer rows printed as one run-on card and split again."""
    cards = join_small(t.customer, t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.concat(
            (F.col("c_custkey") % 9 + 1).cast("string"), F.lit(" weeks ago "), F.col("c_mktsegment"),
            F.lit(" lead Place of work : "), F.col("n_name"), F.lit(" Workload : "),
            (F.col("c_custkey") % 10 * 10 + 10).cast("string"), F.lit("% Contract type : Permanent position "),
            F.col("c_name"), F.lit(" Promoted Is this job relevant to you?")).alias("run"))
    return pg.split_labelled_run(cards, "run", LABELS, r"today|yesterday|[0-9]+\s+(?:days?|weeks?|months?)\s+ago",
                                 ["Permanent position", "Temporary position", "Freelance"],
                                 ["Promoted", "Easy apply", "Top job"], r"Is this job relevant to you\?").drop("run")


@query("b10_canonical_url", f"""SELECT page_id, lower(regexp_replace(split_part(url, '?', 1), '/+$', '')) AS rank_key,
  regexp_replace(regexp_replace(regexp_replace(lower(url), '^https?://(?:www\\.)?', ''), '#.*$', ''), '/+$', '') AS store_key,
  lower(split_part(url, '?', 1)) || '|' || lower({_title_sql()}) AS agent_key FROM pages""")
def _(t):
    titled = t.pages.join(pg.page_fields(t.pages).select("page_id", "title"), "page_id")
    return titled.select("page_id", ux.rank_key("url").alias("rank_key"), ux.store_key("url").alias("store_key"),
                         ux.agent_key("url", "title").alias("agent_key"))


Q_SITES = f"sites AS (SELECT DISTINCT regexp_replace({ux.q_host('url')}, '^(?:m|blog)\\.', '') AS site_host FROM pages)"


def _sites(t):
    return t.pages.select(F.regexp_replace(ux.host("url"), r"^(?:m|blog)\.", "").alias("site_host")).distinct()


@query("b11_host_same_org", f"""WITH {Q_SITES} SELECT page_id, {ux.q_host('url')} AS host, site_host FROM pages, sites
WHERE {ux.q_host('url')} = site_host OR ends_with({ux.q_host('url')}, '.' || site_host)""")
def _(t):
    hosts = t.pages.select("page_id", ux.host("url").alias("host"))
    spread = hosts.withColumn("site_host", F.explode(ux.host_suffixes("host")))
    return join_small(spread, _sites(t), "site_host").select("page_id", "host", "site_host")


@query("b12_filter_on_site", f"""WITH {Q_SITES} SELECT page_id, url, site_host FROM pages, sites
WHERE ({ux.q_host('url')} = site_host OR ends_with({ux.q_host('url')}, '.' || site_host)) AND starts_with(lower({ux.q_path('url')}), '/en')""")
def _(t):
    wanted = _sites(t).withColumn("path_prefix", F.lit("/en"))
    return pg.filter_on_site(t.pages, wanted).select("page_id", "url", "site_host")


@query("b13_detect_source", f"SELECT page_id, {ux.q_first_source(ux.q_host('url'), SOURCES)} AS source FROM pages")
def _(t):
    return t.pages.select("page_id", ux.first_source(ux.host("url"), SOURCES).alias("source"))


@query("b14_classify_url", f"""SELECT page_id, CASE WHEN regexp_matches(lower({ux.q_path('u')}), {q_str(ux.SEARCH_PATH)})
  OR regexp_matches(lower({ux.q_query('u')}), {q_str(ux.SEARCH_QUERY)}) THEN 'search' ELSE 'detail' END AS kind
FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN replace(url, '/en/', '/search/') WHEN page_id % 3 = 1 THEN replace(url, 'ref=', 'q=') ELSE url END AS u FROM pages)""")
def _(t):
    u = (F.when(F.col("page_id") % 3 == 0, F.replace("url", F.lit("/en/"), F.lit("/search/")))
         .when(F.col("page_id") % 3 == 1, F.replace("url", F.lit("ref="), F.lit("q="))).otherwise(F.col("url")))
    return t.pages.select("page_id", u.alias("u")).select(
        "page_id", F.when(ux.is_search_page("u"), "search").otherwise("detail").alias("kind"))


_K = "CAST(json_extract_string(props, '$.k') AS INT)"


@query("b15_classify_fetch", f"""SELECT event_id, CASE WHEN k % 11 = 0 THEN 'skipped' WHEN value > 100 THEN 'ok'
  WHEN k % 7 = 0 THEN 'needs-payment' WHEN k % 7 = 1 THEN 'rate-limited' WHEN k % 7 = 2 OR k % 5 = 0 THEN 'blocked'
  WHEN k % 7 = 3 THEN 'unreachable' ELSE 'empty' END AS outcome
FROM (SELECT *, {_K} AS k FROM events WHERE event_type = 'error')""")
def _(t):
    """Error events read as collection attempts: code and body marker from ``props``."""
    k = F.get_json_object("props", "$.k").cast("int")
    log = t.events.where("event_type = 'error'").select(
        "event_id", (k % 11 == 0).alias("skipped"), F.when(F.col("value") > 100, 1).otherwise(0).alias("n_found"),
        F.when(k % 7 == 0, 402).when(k % 7 == 1, 429).when(k % 7 == 2, 403).when(k % 7 == 3, 500).otherwise(200).alias("http_status"),
        F.when(k % 5 == 0, "Just a moment ...").otherwise("<html>").alias("body"))
    return pg.classify_fetch(log).select("event_id", "outcome")


def _careers_sql():
    site, h, path = ux.q_host("url"), ux.q_host("href"), ux.q_path("href")
    return f"""WITH {Q_LINKS}, l AS (SELECT page_id, pos, href, {site} AS site, {h} AS h, {path} AS p, split_part({site}, '.', 1) AS nm FROM links),
ranked AS (SELECT *, CASE WHEN regexp_matches(h, {q_str(ATS_HOST)}) AND len(list_filter(list_concat(string_split(h, '.'), string_split(lower(p), '/')),
    lambda b: b = nm OR regexp_replace(b, '[-_]', '', 'g') = nm OR (length(nm) >= 4 AND starts_with(b, nm)))) > 0 THEN 1
  WHEN (h = site OR ends_with(h, '.' || site)) AND regexp_matches(p || '/', {q_str(CAREERS_PATH)}) THEN 2 END AS tier FROM l)
SELECT page_id, href AS careers_url FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY tier, pos) AS rn FROM ranked WHERE tier IS NOT NULL) WHERE rn = 1"""


@query("b16_pick_careers_link", _careers_sql())
def _(t):
    return pg.pick_careers_link(pg.extract_anchors(t.pages), ATS_HOST, CAREERS_PATH)


def _site_sql():
    word = f"regexp_replace(split_part({ux.q_host('url')}, '.', 1), '[^a-z0-9]', '', 'g')"
    return f"""WITH hits AS (SELECT split_part(regexp_replace({ux.q_host('url')}, '^(?:m|blog)\\.', ''), '.', 1) AS name, url,
  lower({_title_sql()}) AS title, {word} AS word FROM pages),
wanted AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS want FROM hits),
scored AS (SELECT name, url, (CASE WHEN word = want THEN 6 WHEN length(word) >= 4 AND (contains(want, word) OR contains(word, want)) THEN 4
  WHEN length(want) >= 5 AND length(word) >= 5 AND left(want, 5) = left(word, 5) THEN 2 ELSE 0 END + contains(title, left(name, 18))::INT)::INT AS score FROM wanted WHERE want <> '')
SELECT name, url, score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, url) AS rn FROM scored WHERE score > 0) WHERE rn = 1"""


@query("b17_pick_official_site", _site_sql())
def _(t):
    bare = F.regexp_replace(ux.host("url"), r"^(?:m|blog)\.", "")
    hits = (t.pages.join(pg.page_fields(t.pages).select("page_id", "title"), "page_id")
            .select(F.split(bare, r"\.")[0].alias("name"), "url", "title"))
    return pg.pick_official_site(hits).select("name", "url", "score")


@query("b18_reference_code", f"""SELECT page_id, coalesce(nullif(regexp_extract({ux.q_path('u')}, {q_str(pg.REF_IN_PATH)}, 1), ''),
  nullif(regexp_extract(body, {q_str(pg.REF_IN_TEXT)}, 1), ''), '') AS ref
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace(url, '/en/', '/ref/') ELSE url END AS u, {hx.q_to_text('html')} || ' Job ID: AB-' || page_id::VARCHAR AS body FROM pages)""")
def _(t):
    p = t.pages.withColumn("url", F.when(F.col("page_id") % 2 == 0, F.replace("url", F.lit("/en/"), F.lit("/ref/"))).otherwise(F.col("url")))
    body = F.concat(hx.to_text("html"), F.lit(" Job ID: AB-"), F.col("page_id").cast("string"))
    return pg.extract_reference_code(p, body).select("page_id", "ref")


@query("b19_stable_id", r"SELECT doc_id, 'u-' || md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS content_id FROM documents")
def _(t):
    return t.documents.select("doc_id", pg.stable_id(F.lit(""), F.col("text")).alias("content_id"))


@query("b20_extract_links", f"""SELECT page_id, len(l)::INT AS n_links, array_to_string(list_sort(l), ' ') AS links FROM (
  SELECT page_id, list_distinct(list_transform(regexp_extract_all(url || '. see http://Inkd.in/' || page_id::VARCHAR || ', ' || html, {q_str(ux.LINK)}),
    lambda u: regexp_replace(regexp_replace(u, '[.,;:]+$', ''), '^(https?://)Inkd\\.in/', '\\1lnkd.in/'))) AS l FROM pages)""")
def _(t):
    body = F.concat("url", F.lit(". see http://Inkd.in/"), F.col("page_id").cast("string"), F.lit(", "), F.col("html"))
    found = ux.links(body)
    return t.pages.select("page_id", F.size(found).alias("n_links"), F.array_join(F.array_sort(found), " ").alias("links"))


@query("b21_unwrap_envelope", f"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(source || chr(10) || chr(10) || '**' || lang || '**' || chr(10) || '* ' || text,
  '\\*\\*([^*\\n]+)\\*\\*', '\\1', 'g'), '(?m)^[ \\t]*\\*[ \\t]+', '• ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS body FROM documents""")
def _(t):
    """Documents wrapped in a reader envelope and unwrapped."""
    content = F.concat(F.lit("**"), F.col("lang"), F.lit("**\n* "), F.col("text"))
    env = t.documents.select("doc_id", F.to_json(F.struct(
        F.lit(200).alias("code"), F.struct(F.col("source").alias("title"), content.alias("content")).alias("data"))).alias("body"))
    return env.select("doc_id", pg.unwrap_reader_envelope(F.col("body")).alias("body"))


@query("b22_classify_input", f"""SELECT id, link, CASE WHEN v = '' THEN 'empty' WHEN link = '' THEN 'text' WHEN regexp_matches({ux.q_host('link')}, '(?:^|\\.)example\\.org$') THEN 'profile' ELSE 'url' END AS kind
FROM (SELECT id, v, CASE WHEN regexp_matches(v, '(?i)^https?://\\S+$') THEN v WHEN regexp_matches(v, {q_str(ux.BARE_DOMAIN)}) THEN 'https://' || v ELSE '' END AS link
  FROM (SELECT id, {tx.q_strip('raw')} AS v FROM (
  SELECT 'p' || page_id::VARCHAR AS id, CASE WHEN page_id % 2 = 0 THEN url ELSE regexp_replace(url, '^https?://', '') END AS raw FROM pages
  UNION ALL SELECT 'd' || doc_id::VARCHAR, text FROM documents)))""")
def _(t):
    values = (t.pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.when(
        F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.regexp_replace("url", r"^https?://", "")).alias("value"))
        .unionByName(t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("value"))))
    return pg.classify_input(values, "value", r"(?:^|\.)example\.org$").drop("value")


@query("b23_entity_ids", f"""SELECT page_id, coalesce(nullif(regexp_extract({ux.q_query('u')}, '(?:^|&)page=([0-9]+)', 1), ''),
    nullif(regexp_extract({ux.q_path('u')}, '/([0-9]+)(?:\\.html)?/?$', 1), ''), '') AS entity_id,
  regexp_extract(url_decode(regexp_extract({ux.q_query('u')}, '(?:^|&)to=([^&]*)', 1)), '(?i)^(https?://[^/?#]+)', 1) AS website
FROM (SELECT page_id, split_part(url, '#', 1) || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'to=https%3A%2F%2Fsite' || page_id::VARCHAR || '.test%2Fx' AS u FROM pages)""")
def _(t):
    u = F.concat(F.split("url", "#")[0], F.when(F.contains("url", F.lit("?")), F.lit("&")).otherwise(F.lit("?")),
                 F.lit("to=https%3A%2F%2Fsite"), F.col("page_id").cast("string"), F.lit(".test%2Fx"))
    return pg.extract_entity_ids(t.pages.select("page_id", u.alias("u")), "u", "page", r"/([0-9]+)(?:\.html)?/?$", "to").drop("u")


@query("b23_company_slug", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'acme ' || page_id::VARCHAR WHEN 1 THEN 'sons-&-co' ELSE '' END AS slug FROM pages""")
def _(t):
    """Pages with the board's own link, a plain employer link and, on some, a top-card link."""
    k = F.col("page_id")
    own, plain = F.lit('<a href="https://board.test/company/Board?x=topcard">b</a>'), F.lit('<a href="https://board.test/company/sons-&amp;-co/about">s</a>')
    card = F.concat(F.lit('<a href="https://board.test/company/acme%20'), k.cast("string"), F.lit('?trk=topcard-name">a</a>'))
    html = F.concat("html", own, F.when(k % 3 < 2, plain).otherwise(""), F.when(k % 3 == 0, card).otherwise(""))
    return t.pages.select("page_id", pg.company_slug(html, r"board\.test/company/", "board", "(?i)topcard").alias("slug"))


@query("b24_redirect_target", f"""SELECT page_id, coalesce(list_filter(list_distinct_keep, lambda u: NOT regexp_matches({ux.q_host('u')}, '(?:^|\\.)example\\.(?:org|net)$'))[1], '') AS target
FROM (SELECT page_id, list_transform(regexp_extract_all(url || ' http://other.test/' || page_id::VARCHAR || '. ' || html, {q_str(ux.LINK)}), lambda u: regexp_replace(u, '[.,;:]+$', '')) AS list_distinct_keep FROM pages)""")
def _(t):
    body = F.concat("url", F.lit(" http://other.test/"), F.col("page_id").cast("string"), F.lit(". "), F.col("html"))
    return t.pages.select("page_id", pg.redirect_target(body, r"(?:^|\.)example\.(?:org|net)$").alias("target"))


@query("c10_public_http_filter", f"""SELECT page_id, u AS url FROM (
  SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'http://10.0.0.' || (page_id % 250)::VARCHAR || '/x' WHEN 1 THEN 'https://172.20.1.1/' || page_id::VARCHAR
    WHEN 2 THEN 'http://localhost/' || page_id::VARCHAR WHEN 3 THEN 'https://8.8.8.8:443/' || page_id::VARCHAR WHEN 4 THEN 'http://example.com:8080/' || page_id::VARCHAR ELSE url END AS u, page_id % 6 AS k FROM pages)
WHERE k IN (3, 5)""")
def _(t):
    pid = F.col("page_id").cast("string")
    u = (F.when(F.col("page_id") % 6 == 0, F.concat(F.lit("http://10.0.0."), (F.col("page_id") % 250).cast("string"), F.lit("/x")))
         .when(F.col("page_id") % 6 == 1, F.concat(F.lit("https://172.20.1.1/"), pid))
         .when(F.col("page_id") % 6 == 2, F.concat(F.lit("http://localhost/"), pid))
         .when(F.col("page_id") % 6 == 3, F.concat(F.lit("https://8.8.8.8:443/"), pid))
         .when(F.col("page_id") % 6 == 4, F.concat(F.lit("http://example.com:8080/"), pid)).otherwise(F.col("url")))
    return t.pages.select("page_id", u.alias("url")).where(ux.is_public_http("url"))


def _card_rules(t):
    """One rule per host of the pages: hosts of odd length have no address field."""
    hosts = t.pages.select(ux.host("url").alias("host")).where("host <> ''").distinct()
    fields = lambda names: F.create_map(*[F.lit(x) for n in names for x in (n, CARD_FIELDS[n])])
    return hosts.select(F.concat(F.lit("cards of "), "host").alias("rule"), "host", F.lit(CARD).alias("card"), F.lit("ref").alias("ref"),
                        F.when(F.length("host") % 2 == 0, fields(("url", "ref", "title"))).otherwise(fields(("ref", "title"))).alias("fields"))


@query("u2_card_rules", f"""WITH rules AS (SELECT DISTINCT {ux.q_host('url')} AS host, {q_str(CARD)} AS card, {q_str(CARD_FIELDS['url'])} AS p_url, {q_str(CARD_FIELDS['ref'])} AS p_ref, {q_str(CARD_FIELDS['title'])} AS p_title FROM pages),
c AS (SELECT page_id, host, (ix - 1)::INT AS pos, card, p_url, p_ref, p_title FROM (SELECT page_id, host, p_url, p_ref, p_title, regexp_extract_all(html, {q_str(CARD)}) AS cards FROM pages JOIN rules ON {ux.q_host('url')} = host) x, unnest(x.cards) WITH ORDINALITY AS u(card, ix)),
f AS (SELECT page_id, host, pos, {hx.q_to_text("regexp_extract(card, " + q_str(CARD_FIELDS['url']) + ", 1)")} AS url, {hx.q_to_text("regexp_extract(card, " + q_str(CARD_FIELDS['ref']) + ", 1)")} AS ref, {hx.q_to_text("regexp_extract(card, " + q_str(CARD_FIELDS['title']) + ", 1)")} AS title FROM c)
SELECT page_id, pos, 'cards of ' || host AS rule, ref, title, CASE WHEN length(host) % 2 = 0 THEN url END AS url FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, ref ORDER BY pos) AS rn FROM f WHERE host <> '' AND ref <> '' AND title <> '' AND (length(host) % 2 = 1 OR url <> '')) WHERE rn = 1""")
def _(t):
    cards = pg.cards_by_rules(t.pages, _card_rules(t), ux.host("url"))
    return cards.select("page_id", "pos", "rule", *[F.try_element_at("fields", F.lit(n)).alias(n) for n in ("ref", "title", "url")])


_BY_HOST = ("^https?://[^/]+/([a-z]{6,})$", "by host", "somewhere", "(?i)(ing)", "(?i)^(?:with)$")


def _link_rules(t, anchors):
    """The two rules for any host, and one for every host that links lead to."""
    names = ("rule", "host", "source", "pattern", "company", "place", "place_pattern", "skip")
    fixed = t.spark.createDataFrame([(f"{i}", pg.ANY_HOST, r.source, r.pattern, r.company, r.place, r.place_pattern, r.skip) for i, r in enumerate(LINK_RULES)], ", ".join(f"{n} string" for n in names))
    hosts = anchors.select(ux.host("href").alias("host")).where("host <> ''").distinct()
    pattern, company, place, place_pattern, skip = map(F.lit, _BY_HOST)
    return fixed.unionByName(hosts.select(F.concat(F.lit("h"), "host").alias("rule"), "host", F.col("host").alias("source"), pattern.alias("pattern"), company.alias("company"),
                                          place.alias("place"), place_pattern.alias("place_pattern"), skip.alias("skip")))


@query("u2_link_rules", f"""WITH {Q_LINKS}, rules AS (SELECT * FROM (VALUES {", ".join(f"('{i}', '*', {q_str(r.source)}, {q_str(r.pattern)}, {q_str(r.company)}, {q_str(r.place)}, {q_str(r.place_pattern)}, {q_str(r.skip)})" for i, r in enumerate(LINK_RULES))}) v(rule, host, source, pattern, company, place, place_pattern, skip)
  UNION ALL SELECT DISTINCT 'h' || {ux.q_host('href')}, {ux.q_host('href')}, {ux.q_host('href')}, {", ".join(map(q_str, _BY_HOST))} FROM links WHERE {ux.q_host('href')} <> ''),
m AS (SELECT l.*, r.*, row_number() OVER (PARTITION BY page_id, pos ORDER BY rule) AS k FROM (SELECT page_id, pos, href, label, {ux.q_host('href')} AS h FROM links) l JOIN rules r ON (r.host = l.h OR r.host = '*') AND regexp_matches(href, pattern)),
f AS (SELECT page_id, pos, source, label AS title, regexp_extract(href, pattern, 1) AS ref, company, coalesce(nullif(regexp_extract(label, place_pattern, 1), ''), place) AS location, split_part(href, '?', 1) AS url FROM m WHERE k = 1 AND length(label) BETWEEN 4 AND 160 AND NOT regexp_matches(label, skip))
SELECT page_id, pos, source, title, ref, company, location, url FROM (SELECT *, row_number() OVER (PARTITION BY source, ref ORDER BY page_id, pos) AS rn FROM f) WHERE rn = 1""")
def _(t):
    anchors = pg.extract_anchors(t.pages)
    return pg.links_by_rules(anchors, _link_rules(t, anchors), ux.host("href"))
