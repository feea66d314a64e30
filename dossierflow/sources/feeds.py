"""Public JSON feeds, structured page data and message headers to one schema; snapshots."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierflow.functions import html as hx
from dossierflow.functions import text as tx

JOB_FIELDS = ("`@type`:string,title:string,url:string,description:string,hiringOrganization:struct<name:string,sameAs:string>,"
              "jobLocation:struct<address:struct<addressLocality:string,addressRegion:string,addressCountry:string>>,identifier:struct<value:string>")
SEARCH_HOSTS = r"(?i)(?:bing|microsoft|iciba|baidu|youdao)\.com|wikipedia\.org|dict\."


@dataclass(frozen=True)
class FeedMapping:
    """Where each listing field lives in a feed's parsed record; a path is a column expression in SQL."""
    source: str
    schema: str
    title: str = "title"
    company: str = "company"
    location: str = "location"
    url: str = "url"
    ref: str = "id"
    ref_prefix: str = ""
    posted: str = "created"
    posted_epoch: bool = False
    text: str = "description"
    salary_min: str | None = None
    salary_max: str | None = None
    salary_predicted: str | None = None
    salary: str | None = None
    defaults: dict = field(default_factory=dict)


# The fields of four public JSON feeds, by the array that holds their records.
SLUG_FEED = FeedMapping("slug-feed", "title string, company_name string, location string, remote boolean, url string, slug string, created_at long, description string",
                        company="company_name", location="coalesce(nullif(location, ''), CASE WHEN remote THEN 'Remote / Europe' ELSE 'Germany' END)", ref="slug", posted="created_at",
                        posted_epoch=True)
SALARY_FEED = FeedMapping("salary-feed", "id string, title string, company struct<display_name:string>, location struct<display_name:string>, redirect_url string, created string, "
                          "salary_min double, salary_max double, salary_is_predicted string, description string", company="company.display_name", location="location.display_name",
                          url="redirect_url", ref_prefix="ADZ-", salary_min="salary_min", salary_max="salary_max", salary_predicted="salary_is_predicted")
SNIPPET_FEED = FeedMapping("snippet-feed", "id string, title string, company string, location string, link string, updated string, salary string, snippet string", url="link",
                           ref_prefix="JOOBLE-", posted="updated", text="snippet", salary="salary")
REMOTE_FEED = FeedMapping("remote-feed", "id string, title string, company_name string, candidate_required_location string, url string, publication_date string, description string",
                          company="company_name", location="candidate_required_location", posted="publication_date", defaults={"location": "Remote"})
FEED_RECORDS = {"slug-feed": "data", "salary-feed": "results", "snippet-feed": "jobs", "remote-feed": "jobs"}


def read_feed(spark: SparkSession, path: str, records: str) -> DataFrame:
    """Landed JSON bodies, one file each, to one row per record: ``file, pos, record`` (JSON). ``records`` is the field that holds them."""
    body = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = F.from_json(F.get_json_object("value", f"$.{records}"), "array<string>")
    return body.select("file", F.posexplode(rows).alias("pos", "record"))


def _salary(m: FeedMapping) -> Column:
    """Stated salaries only: ``min – max / year`` with thousands separators, the estimate of a feed never."""
    if m.salary:
        return F.trim(F.coalesce(F.expr(m.salary), F.lit("")))
    if not m.salary_min:
        return F.lit("")
    lo, hi = F.expr(m.salary_min).cast("double"), F.expr(m.salary_max).cast("double")
    shown = lambda v: F.when(v > 0, F.format_number(F.round(v), 0))
    joined = F.concat_ws(" – ", shown(lo), shown(hi))
    stated = F.expr(m.salary_predicted).cast("string") == "0"
    return F.when(stated & (joined != ""), F.concat(joined, F.lit(" / year"))).otherwise("")


def normalize_feed(raw: DataFrame, json: str, m: FeedMapping) -> DataFrame:
    """One JSON record per row to the listing schema."""
    keep = [c for c in raw.columns if c != json]
    r = raw.select(*keep, F.from_json(json, m.schema).alias("r")).select(*keep, "r.*")
    s = lambda p, name: F.trim(F.coalesce(F.expr(p).cast("string"), F.lit(m.defaults.get(name, ""))))
    url = s(m.url, "url")
    posted = (F.date_format(F.timestamp_seconds(F.expr(m.posted).cast("long")), "yyyy-MM-dd") if m.posted_epoch
              else F.left(s(m.posted, "posted"), F.lit(10)))
    return r.select(
        *keep, s(m.title, "title").alias("title"), s(m.company, "company").alias("company"), s(m.location, "location").alias("location"),
        F.when(url.rlike(r"(?i)^https?://") | (url == ""), url).otherwise(F.concat(F.lit("https://"), F.regexp_replace(url, "^/+", ""))).alias("url"),
        F.concat(F.lit(m.ref_prefix), s(m.ref, "ref")).alias("ref"), posted.alias("posted"), _salary(m).alias("salary"),
        hx.to_lines(s(m.text, "text")).alias("text"), F.lit("page").alias("kind"), F.lit(m.source).alias("source"))


def extract_json_ld_jobs(pages: DataFrame) -> DataFrame:
    """Job postings embedded in pages: a single object, an array or an ``@graph``."""
    blocks = pages.select("page_id", F.explode(hx.json_ld_blocks("html")).alias("_b"))
    one, many_type = f"struct<{JOB_FIELDS}>", f"array<struct<{JOB_FIELDS}>>"
    many = F.coalesce(
        F.when(F.trim("_b").startswith("["), F.from_json("_b", many_type)),
        F.from_json(F.get_json_object("_b", "$['@graph']"), many_type),
        F.array(F.from_json("_b", one)))
    j = blocks.select("page_id", F.explode(many).alias("j")).where(F.col("j.@type") == "JobPosting")
    a = F.col("j.jobLocation.address")
    clean = lambda c: F.coalesce(hx.to_text(c), F.lit(""))
    return (j.select("page_id", clean(F.col("j.title")).alias("title"), clean(F.col("j.hiringOrganization.name")).alias("company"),
                     clean(F.coalesce(a["addressLocality"], a["addressRegion"], a["addressCountry"])).alias("location"),
                     F.coalesce(F.col("j.url"), F.col("j.hiringOrganization.sameAs"), F.lit("")).alias("url"), clean(F.col("j.description")).alias("text"))
            .where("title <> '' AND url <> ''"))


def extract_rss_items(feeds: DataFrame, xml: str, skip_host: str = SEARCH_HOSTS) -> DataFrame:
    """Items of RSS bodies; search engines' own and reference sites are skipped."""
    keep = [c for c in feeds.columns if c != xml]
    items = feeds.select(*keep, F.posexplode(F.regexp_extract_all(xml, F.lit(r"(?is)<item>(.*?)</item>"), F.lit(1))).alias("pos", "_i"))
    part = lambda tag: hx.to_text(F.regexp_extract("_i", rf"(?is)<{tag}>(.*?)</{tag}>", 1))
    return (items.select(*keep, "pos", part("title").alias("title"), part("link").alias("url"), part("description").alias("content"))
            .where((F.col("title") != "") & F.col("url").rlike(r"(?i)^https?://") & ~F.col("url").rlike(skip_host)))


# Header names per field in four languages.
HEADER_NAMES = (("from", "from|von|de"), ("date", "sent|gesendet|date|datum|envoyé"), ("to", "to|an|à"), ("cc", "cc|kopie|copie"), ("subject", "subject|betreff|objet"))


def read_message_headers(messages: DataFrame, text: str) -> DataFrame:
    """Leading header lines of a pasted message to columns; a repeated ``to`` or ``cc`` is joined, blank lines before them are passed over, others keep the first; the rest is the body."""
    names = "|".join(n for _, n in HEADER_NAMES)
    block = rf"(?iu)^(?:[ \t]*\n)*((?:[ \t]*(?:{names})[ \t]*:[^\n]*(?:\n|$))+)"
    head = F.regexp_extract(F.regexp_replace(text, r"\r\n?", "\n"), block, 1)
    rows = F.split(head, "\n")
    out = messages.withColumn("_rows", rows)
    for col, pattern in HEADER_NAMES:
        got = _header_values("_rows", pattern)
        out = out.withColumn(col, F.array_join(got, ", ") if col in ("to", "cc") else F.coalesce(F.get(got, F.lit(0)), F.lit("")))
    return out.withColumn("body", tx.strip(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), block, ""))).drop("_rows")


def _header_values(rows: str, pattern: str) -> Column:
    line = rf"(?iu)^[ \t]*(?:{pattern})[ \t]*:(.*)$"
    return F.transform(F.filter(rows, lambda r: r.rlike(line)), lambda r: F.trim(F.regexp_extract(r, line, 1)))


def snapshot_summary(listings: DataFrame, at: str, stale: Column) -> DataFrame:
    return (listings.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.bool_or(stale).alias("stale"))
            .withColumn("snapshot_date", F.lit(at)))


def write_snapshot(listings: DataFrame, path: str, at: str, files_per_source_rows: int = 5_000_000) -> None:
    """Listings partitioned by date and source; a day that is written again replaces its own partitions and no others. The writer
    keeps incoming partitions, so a hot source is written by many tasks."""
    (listings.withColumn("snapshot_date", F.lit(at)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("maxRecordsPerFile", files_per_source_rows)
     .partitionBy("snapshot_date", "source").parquet(path))
