"""Feeds, exports, embedded data and headers, built from the given tables and read back."""
from pyspark.sql import functions as F

from dossierflow.catalog import query
from dossierflow.functions import html as hx
from dossierflow.functions import text as tx
from dossierflow.sources import exports as ex
from dossierflow.sources import feeds as fd

FEED = fd.FeedMapping(
    source="board", schema="id long, title string, company struct<display_name:string>, location struct<display_name:string>, redirect_url string, created long, description string, salary_min double, salary_max double, salary_is_predicted int",
    company="company.display_name", location="location.display_name", url="redirect_url", ref_prefix="B-", posted_epoch=True,
    salary_min="salary_min", salary_max="salary_max", salary_predicted="salary_is_predicted")


@query("a2_snapshot_summary", "SELECT source, count(*) AS n_rows, bool_or(n_chars < 30) AS stale, '2026-11-18' AS snapshot_date FROM documents GROUP BY 1")
def _(t):
    return fd.snapshot_summary(t.documents, "2026-11-18", F.col("n_chars") < 30)


@query("a3_normalize_feed", """SELECT o_orderkey, o_orderpriority AS title, c_name AS company, c_mktsegment AS location, 'https://board.test/' || o_orderkey::VARCHAR AS url, 'B-' || o_orderkey::VARCHAR AS ref, strftime(o_orderdate, '%Y-%m-%d') AS posted,
  CASE WHEN o_orderkey % 3 = 0 THEN format('{:,}', (o_orderkey % 90 + 10)::BIGINT * 1000) || ' – ' || format('{:,}', (o_orderkey % 90 + 20)::BIGINT * 1000) || ' / year' ELSE '' END AS salary, 'Lead the ' || lower(c_mktsegment) || ' business' AS text
FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(t):
    """Orders written as one feed's JSON records and mapped back."""
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    rec = F.to_json(F.struct(
        k.alias("id"), F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")).alias("title"), F.struct(F.col("c_name").alias("display_name")).alias("company"),
        F.struct(F.col("c_mktsegment").alias("display_name")).alias("location"), F.concat(F.when(k % 2 == 0, "https://board.test/").otherwise("//board.test/"), k.cast("string")).alias("redirect_url"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("created"), F.concat(F.lit("<b>Lead</b> the "), F.lower("c_mktsegment"), F.lit(" business")).alias("description"),
        ((k % 90 + 10) * 1000).alias("salary_min"), ((k % 90 + 20) * 1000).alias("salary_max"), F.when(k % 3 == 0, 0).otherwise(1).alias("salary_is_predicted")))
    return fd.normalize_feed(j.select("o_orderkey", rec.alias("json")), "json", FEED).drop("kind", "source")


@query("a3_props_feed", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def _(t):
    return t.events.select("event_id", F.from_json("props", "k int").alias("p")).select("event_id", "p.k")


@query("a4_parse_export_rows", """SELECT c_custkey, c_name || ', "' || c_mktsegment || '"' AS company, c_mktsegment AS title, 'line one' || chr(10) || 'line two' AS description FROM customer""")
def _(t):
    """Customers as quoted CSV records with commas, doubled quotes and a line break inside a field."""
    line = F.concat(F.lit('"'), "c_name", F.lit(', ""'), "c_mktsegment", F.lit('""",'), "c_mktsegment", F.lit(',"line one\nline two"'))
    return ex.parse_export_rows(t.customer.select("c_custkey", line.alias("line")), "line", ["company", "title", "description"])


@query("a5_classify_export_files", """SELECT path, CASE WHEN never THEN NULL WHEN k = 0 THEN 'positions' WHEN k = 1 THEN 'skills' WHEN k = 2 THEN 'positions' ELSE 'education' END AS kind, never, k = 0 AND rk = 1 OR k = 1 AND rk = 1 OR k = 4 AND rk = 1 AS claims FROM (
  SELECT *, k = 3 AS never, row_number() OVER (PARTITION BY k ORDER BY path) AS rk FROM (SELECT s_suppkey % 5 AS k, 'x/' || CASE s_suppkey % 5 WHEN 0 THEN 'Positions' WHEN 1 THEN 'Skills' WHEN 2 THEN 'renamed' WHEN 3 THEN 'messages' ELSE 'old' END || '_' || lpad(s_suppkey::VARCHAR, 6, '0') || '.csv' AS path FROM supplier))""")
def _(t):
    """File names made from supplier keys: named, renamed (known by header), never-read, and a second header-only kind."""
    k = F.col("s_suppkey") % 5
    name = F.when(k == 0, "Positions").when(k == 1, "Skills").when(k == 2, "renamed").when(k == 3, "messages").otherwise("old")
    header = (F.when(k == 2, F.array(F.lit("Company Name"), F.lit("Title"), F.lit("Started On"))).when(k == 4, F.array(F.lit("School Name"), F.lit("Degree Name")))
              .otherwise(F.array(F.lit("Name"))))
    files = t.supplier.select(F.concat(F.lit("x/"), name, F.lit("_"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.lit(".csv")).alias("path"), header.alias("header"), F.lit(1).alias("n_records"))
    return ex.classify_export_files(files)


@query("a6_json_ld_jobs", rf"""SELECT page_id, 'Lead ' || page_id::VARCHAR AS title, 'Firm & Co' AS company, CASE WHEN page_id % 2 = 0 THEN 'Bern' ELSE 'CH' END AS location, url, 'Run the place' AS text FROM pages WHERE page_id % 4 <> 3""")
def _(t):
    """Structured data added to every page in three shapes, and a fourth that is no posting."""
    pid, k = F.col("page_id").cast("string"), F.col("page_id") % 4
    where = F.when(F.col("page_id") % 2 == 0, F.lit('"addressLocality":"Bern","addressCountry":"CH"')).otherwise(F.lit('"addressCountry":"CH"'))
    job = F.concat(F.lit('{"@type":"'), F.when(k == 3, "Event").otherwise("JobPosting"), F.lit('","title":"Lead '), pid, F.lit('","url":"'), F.col("url"),
                   F.lit('","description":"<p>Run the place</p>","hiringOrganization":{"name":"Firm &amp; Co"},"jobLocation":{"address":{'), where, F.lit("}}}"))
    body = F.when(k == 1, F.concat(F.lit("["), job, F.lit("]"))).when(k == 2, F.concat(F.lit('{"@graph":['), job, F.lit("]}"))).otherwise(job)
    html = F.concat("html", F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))
    return fd.extract_json_ld_jobs(t.pages.select("page_id", html.alias("html")))


@query("a7_rss_items", rf"""SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS pos, role AS title, 'https://site.test/' || conv_id::VARCHAR || '/' || turn::VARCHAR AS url, {hx.q_to_text('text')} AS content FROM conversations QUALIFY role <> 'system'""")
def _(t):
    """Turns written as RSS items per conversation; system turns point at a skipped host."""
    link = F.concat(F.when(F.col("role") == "system", "https://www.bing.com/").otherwise("https://site.test/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    item = F.concat(F.lit("<item><title>"), "role", F.lit("</title><link>"), link, F.lit("</link><description>"), "text", F.lit("</description></item>"))
    xml = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("x")))), lambda r: r["x"]), "").alias("xml"))
    return fd.extract_rss_items(xml, "xml")


@query("a8_message_headers", f"""SELECT conv_id, turn, role || '@mail.test' AS "from", 'a@x.test, b@x.test' AS "to", 'c@x.test' AS cc, 'Turn ' || turn::VARCHAR AS subject, '2026-11-' || lpad((turn + 1)::VARCHAR, 2, '0') AS "date", {tx.q_strip('text')} AS body FROM conversations""")
def _(t):
    raw = F.concat(F.lit("\nVon: "), "role", F.lit("@mail.test\nGesendet: 2026-11-"), F.lpad((F.col("turn") + 1).cast("string"), 2, "0"), F.lit("\nTo: a@x.test\nCc: c@x.test\nTo: b@x.test\nBetreff: Turn "),
                   F.col("turn").cast("string"), F.lit("\n\n"), "text")
    return fd.read_message_headers(t.conversations.select("conv_id", "turn", raw.alias("raw")), "raw").drop("raw")


@query("e21_export_report", """SELECT o_orderpriority AS kind, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_imported, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_skipped, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_capped FROM orders GROUP BY 1""")
def _(t):
    status = F.when(F.col("o_orderstatus") == "F", "imported").when(F.col("o_orderstatus") == "O", "skipped").otherwise("capped")
    return ex.export_report(t.orders.select(F.col("o_orderpriority").alias("kind"), status.alias("status")))
