"""Scraped pages to links, cards, fields and picks."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierflow.functions import html as hx
from dossierflow.functions import text as tx
from dossierflow.functions import urls as ux
from dossierflow.operators.scale import join_small, keep_first

# Menu labels that are never titles, wrappers printed around document links.
MENU_LABEL = (r"(?i)^(home|contact|imprint|privacy|back|more|login|sign in|register|about|terms|help|next|previous|"
              r"read more|apply|search|filter|jobs|careers|vacancies)$")
GENDER_TAG = r"(?i)\((?:m|f|w|d|x)\s*/\s*(?:m|f|w|d|x)(?:\s*/\s*(?:m|f|w|d|x))?\)"
DOCUMENT_LINK = r"(?i)\.(?:pdf|docx?)(?:$|\?)|/download/"
TITLE_WORD = (r"(?i)(manager|director|officer|coordinator|assistant|consultant|intern|specialist|head of|executive|"
              r"advisor|clerk|sachbearbeiter|referent|ceo|cfo|coo)")
REF_IN_PATH = r"(?i)/ref/([a-z0-9-]+)"
REF_IN_TEXT = r"(?i)(?:^|[^\p{L}\p{N}])(?:ref(?:erence)?|job\s*id|kennziffer)\s*[:#.]?\s*([A-Z0-9-]{4,20})(?:$|[^\p{L}\p{N}-])"


def extract_anchors(pages: DataFrame, html: str = "html", base: str = "url") -> DataFrame:
    """One row per usable link: page columns, ``pos``, ``href`` (absolute, no fragment), ``label``."""
    keep = [c for c in pages.columns if c != html]
    found = pages.select(*keep, F.posexplode(hx.anchors(html)).alias("pos", "_a"))
    return (found
            .select(*keep, "pos", hx.anchor_href("_a").alias("_h"), hx.anchor_label("_a").alias("label"))
            .where((F.col("_h") != "") & (F.col("label") != "")
                   & ~F.col("_h").rlike(r"(?i)^(?:#|javascript:|mailto:)"))
            .withColumn("href", ux.resolve("_h", base)).drop("_h"))


def extract_markdown_links(df: DataFrame, text: str) -> DataFrame:
    keep = [c for c in df.columns if c != text]
    links = df.select(*keep, F.posexplode(
        F.regexp_extract_all(text, F.lit(hx.MARKDOWN_LINK), F.lit(0))).alias("pos", "_m"))
    label = tx.squeeze(F.regexp_replace(F.regexp_extract("_m", r"^\[([^\]]*)\]", 1), r"\*\*|__|`", ""))
    target = F.regexp_replace(F.split(F.regexp_extract("_m", r"\]\((.*)\)$", 1), "#")[0], r"[),.;]+$", "")
    return (links.select(*keep, "pos", label.alias("label"), target.alias("href"))
            .where((F.col("label") != "") & (F.col("href") != "")))


def page_fields(pages: DataFrame) -> DataFrame:
    """Title by precedence (structured data, heading, document title up to its separator) and body."""
    ld = F.try_element_at(hx.json_ld_blocks("html"), F.lit(1))
    ld_title = F.nullif(hx.to_text(F.get_json_object(ld, "$.title")), F.lit(""))
    ld_text = hx.to_text(F.get_json_object(ld, "$.description"))
    head = F.split(hx.first_tag("html", "title"), r"\s+[|–—-]\s+")[0]
    return pages.select(
        "page_id",
        F.coalesce(ld_title, hx.first_tag("html", "h1"), F.nullif(head, F.lit("")), F.lit("")).alias("title"),
        F.when(F.length(ld_text) > 120, ld_text).otherwise(hx.to_lines("html")).alias("body"))


def extract_repeating_cards(pages: DataFrame, card: str, fields: dict[str, str], ref: str) -> DataFrame:
    """Cut a page at a repeating element, read one field per pattern, keep the first card per reference."""
    cards = pages.select("page_id", F.posexplode(
        F.regexp_extract_all("html", F.lit(card), F.lit(0))).alias("pos", "_card"))
    read = cards.select("page_id", "pos", *[
        hx.to_text(F.regexp_extract("_card", pattern, 1)).alias(name) for name, pattern in fields.items()])
    whole = read.where(" AND ".join(f"`{name}` <> ''" for name in fields))
    return keep_first(whole, ["page_id", ref], [F.col("pos")])


@dataclass(frozen=True)
class LinkRule:
    source: str
    pattern: str  # one capture group: the reference
    company: str
    place: str
    place_pattern: str = r"(?!)"
    skip: str = r"(?i)^(?:read more|apply|save job|view|similar jobs)$"


def extract_by_link_rules(anchors: DataFrame, rules: list[LinkRule]) -> DataFrame:
    """First rule whose address pattern matches names the source; label length 4 to 160; first row per reference."""
    def pick(value) -> Column:
        out = None
        for r in rules:
            out = (out if out is not None else F).when(F.col("href").rlike(r.pattern), value(r))
        return out

    rows = (anchors
            .withColumn("source", pick(lambda r: F.lit(r.source)))
            .where(F.col("source").isNotNull() & F.length("label").between(4, 160))
            .where(~pick(lambda r: F.col("label").rlike(r.skip)))
            .select("page_id", "pos", "source", F.col("label").alias("title"),
                    pick(lambda r: F.regexp_extract("href", r.pattern, 1)).alias("ref"),
                    pick(lambda r: F.lit(r.company)).alias("company"),
                    pick(lambda r: F.coalesce(F.nullif(F.regexp_extract("label", r.place_pattern, 1), F.lit("")),
                                              F.lit(r.place))).alias("location"),
                    F.split("href", r"\?")[0].alias("url")))
    return keep_first(rows, ["source", "ref"], [F.col("page_id"), F.col("pos")])


def filter_navigation_links(anchors: DataFrame, title_word: str = TITLE_WORD, menu: str = MENU_LABEL) -> DataFrame:
    title = tx.strip(F.regexp_replace(F.regexp_replace(
        F.col("label"), r"(?i)^\s*Filetype:\s*\w+\s*", ""), r"(?i)\s*Filesize:\s*[0-9.,]+\s*[kmg]?b\s*$", ""))
    is_doc = F.col("href").rlike(DOCUMENT_LINK)
    titled = (F.col("title").rlike(GENDER_TAG) | F.col("title").rlike(title_word)) & F.length("title").between(9, 159)
    return (anchors.withColumn("title", title)
            .where((F.col("title") != "") & ~F.col("title").rlike(menu))
            .where(titled | (is_doc & (F.length("title") > 8)))
            .withColumn("kind", F.when(is_doc, "document").otherwise("page")))


def split_labelled_run(df: DataFrame, run: str, labels: list[tuple[str, str]], age: str, contracts: list[str],
                       noise: list[str], tail: str) -> DataFrame:
    """One run-on string to columns: optional age, title before the first label, a value per label up to the
    next label, and after the last label a known contract kind followed by the employer."""
    s = tx.squeeze(F.regexp_replace(tx.squeeze(run), rf"(?i)\s*{tail}\s*$", ""))
    out = df.withColumn("_s", s).withColumn("age", F.regexp_extract("_s", rf"(?i)^({age})\s", 1))
    out = out.withColumn("_s", F.when(F.col("age") != "", F.expr("substring(_s, length(age) + 2)")).otherwise(F.col("_s")))
    out = out.withColumn("title", tx.strip(F.regexp_extract("_s", rf"(?i)^(.*?)\s+{labels[0][1]}\s*:", 1)))
    for i, (name, label) in enumerate(labels[:-1]):
        later = "|".join(rf"{nxt}\s*:" for _, nxt in labels[i + 1:])
        out = out.withColumn(name, tx.strip(F.regexp_extract("_s", rf"(?i){label}\s*:\s*(.+?)\s*(?:{later}|$)", 1)))
    name, label = labels[-1]
    rest = F.regexp_extract("_s", rf"(?i){label}\s*:\s*(.+)$", 1)
    kinds = "|".join(contracts)
    out = out.withColumn(name, F.regexp_extract(rest, rf"(?i)^({kinds})(?:\s|$)", 1))
    company = F.regexp_replace(F.regexp_extract(rest, rf"(?i)^(?:{kinds})\s*(.*)$", 1),
                               rf"(?i)\s*(?:{'|'.join(noise)})(?:\s|$)", "")
    return out.withColumn("company", tx.strip(company)).drop("_s")


def filter_on_site(hits: DataFrame, sites: DataFrame, url: str = "url") -> DataFrame:
    """Hits that really lie on a wanted site: host equal or subdomain (equi join on host suffixes) and path prefix.

    ``sites``: ``site_host``, ``path_prefix`` ('' for any)."""
    spread = hits.withColumn("site_host", F.explode(ux.host_suffixes(ux.host(url))))
    return join_small(spread, sites, "site_host").where(
        F.lower(ux.path(url)).startswith(F.lower(F.col("path_prefix"))))


def classify_fetch(log: DataFrame) -> DataFrame:
    """Outcome of a collection attempt from its status code, body markers and rows found."""
    blocked = F.col("http_status").isin(401, 403, 503)
    wall = F.col("body").rlike(r"(?i)captcha|cf-chl|just a moment|access denied|are you a robot|verify you are human")
    return log.withColumn(
        "outcome",
        F.when(F.col("skipped"), "skipped")
        .when(F.col("n_found") > 0, "ok")
        .when(F.col("http_status") == 402, "needs-payment")
        .when(F.col("http_status") == 429, "rate-limited")
        .when(blocked | wall, "blocked")
        .when(F.col("http_status").isNull() | ~F.col("http_status").between(200, 299), "unreachable")
        .otherwise("empty"))


def pick_careers_link(anchors: DataFrame, ats_host: str, careers_path: str) -> DataFrame:
    """Per page: an applicant-system link that carries the company's own name, else its own careers page."""
    site = ux.host("url")
    h = ux.host("href")
    name = F.split(site, r"\.")[0]
    labels = F.concat(F.split(h, r"\."), F.split(F.lower(ux.path("href")), "/"))
    carries = F.exists(labels, lambda b: (b == name) | (F.regexp_replace(b, "[-_]", "") == name)
                       | ((F.length(name) >= 4) & b.startswith(name)))
    own = (h == site) | h.endswith(F.concat(F.lit("."), site))
    ranked = anchors.withColumn(
        "_tier", F.when(h.rlike(ats_host) & carries, 1)
        .when(own & F.concat(ux.path("href"), F.lit("/")).rlike(careers_path), 2))
    best = keep_first(ranked.where(F.col("_tier").isNotNull()), ["page_id"], [F.col("_tier"), F.col("pos")])
    return best.select("page_id", F.col("href").alias("careers_url"))


def pick_official_site(hits: DataFrame) -> DataFrame:
    """Best hit per name: host word against the name's slug; ``hits``: ``name, url, title``."""
    want = F.regexp_replace(F.lower("name"), "[^a-z0-9]", "")
    word = F.regexp_replace(F.split(ux.host("url"), r"\.")[0], "[^a-z0-9]", "")
    base = (F.when(word == want, 6)
            .when((F.length(word) >= 4) & (F.contains(want, word) | F.contains(word, want)), 4)
            .when((F.length(want) >= 5) & (F.length(word) >= 5) & (F.left(want, F.lit(5)) == F.left(word, F.lit(5))), 2)
            .otherwise(0))
    named = F.contains(F.lower("title"), F.left(F.lower("name"), F.lit(18))).cast("int")
    scored = (hits.withColumn("score", (base + named).cast("int"))
              .where((F.col("score") > 0) & (want != "") & (ux.host("url") != "")))
    return keep_first(scored, ["name"], [-F.col("score"), F.col("url")])


def extract_reference_code(pages: DataFrame, body: Column) -> DataFrame:
    ld = F.try_element_at(hx.json_ld_blocks("html"), F.lit(1))
    return pages.withColumn("ref", F.coalesce(
        F.nullif(F.get_json_object(ld, "$.identifier.value"), F.lit("")),
        F.nullif(F.regexp_extract(ux.path("url"), REF_IN_PATH, 1), F.lit("")),
        F.nullif(F.regexp_extract(body, REF_IN_TEXT, 1), F.lit("")),
        F.lit("")))


def stable_id(url: Column, text: Column) -> Column:
    """Content id from the address, else from the whitespace-folded text."""
    return F.concat(F.lit("u-"), F.md5(F.when(
        F.coalesce(url, F.lit("")) != "", ux.store_key(url)).otherwise(tx.squeeze(F.lower(text)))))


def unwrap_reader_envelope(body: Column) -> Column:
    """JSON envelope to ``title, blank line, content``; bold and star bullets cleaned, blank runs folded."""
    inner = F.coalesce(F.nullif(F.get_json_object(body, "$.data.content"), F.lit("")),
                       F.nullif(F.get_json_object(body, "$.data.text"), F.lit("")),
                       F.nullif(F.get_json_object(body, "$.content"), F.lit("")))
    title = F.coalesce(F.get_json_object(body, "$.data.title"), F.get_json_object(body, "$.title"), F.lit(""))
    joined = F.when(title != "", F.concat(title, F.lit("\n\n"), inner)).otherwise(inner)
    s = F.when(body.rlike(r"^\s*\{"), F.coalesce(joined, body)).otherwise(body)
    s = F.regexp_replace(s, r"\*\*([^*\n]+)\*\*", "$1")
    s = F.regexp_replace(s, r"(?m)^[ \t]*\*[ \t]+", "• ")
    return F.regexp_replace(s, r"\n{3,}", "\n\n")


def classify_input(df: DataFrame, value: str, profile_host: str) -> DataFrame:
    """empty / profile / url / text; a bare domain on one line is still a link."""
    raw = tx.strip(value)
    link = (F.when(raw.rlike(r"(?i)^https?://\S+$"), raw)
            .when(raw.rlike(ux.BARE_DOMAIN), F.concat(F.lit("https://"), raw)))
    return (df.withColumn("link", F.coalesce(link, F.lit("")))
            .withColumn("kind", F.when(raw == "", "empty")
                        .when(link.isNull(), "text")
                        .when(ux.host(link).rlike(profile_host), "profile")
                        .otherwise("url")))


def extract_entity_ids(df: DataFrame, url: str, id_param: str, id_path: str, redirect_param: str) -> DataFrame:
    """Numeric id from the query or else the path; the site behind a redirect parameter."""
    return (df.withColumn("entity_id", F.coalesce(
                F.nullif(F.regexp_extract(ux.query_string(url), rf"(?:^|&){id_param}=([0-9]+)", 1), F.lit("")),
                F.nullif(F.regexp_extract(ux.path(url), id_path, 1), F.lit("")), F.lit("")))
            .withColumn("website", F.regexp_extract(
                F.url_decode(ux.query_value(url, redirect_param)), r"(?i)^(https?://[^/?#]+)", 1)))


def company_slug(html: Column, base: str, own: str, top: str) -> Column:
    """The employer's slug on a page: of the links to ``base`` + slug that are not the board's ``own``, the first whose rest matches
    ``top`` (the top card), else the first; empty if there is none. Entities and percent codes in a slug are read."""
    slug = r"((?:&#?\w+;|[^/?#&\"'\s<>)\]])+)"
    found = F.regexp_extract_all(html, F.lit(rf"{base}{slug}([^\"'\s<>]*)"), F.lit(0))

    def read(link: Column) -> Column:
        raw = hx.to_text(F.regexp_extract(link, rf"{base}{slug}", 1))
        rest = F.regexp_extract(link, rf"{base}{slug}(.*)$", 2)
        return F.struct(F.coalesce(F.try_url_decode(raw), raw).alias("slug"), rest.rlike(top).alias("top"))

    kept = F.filter(F.transform(found, read), lambda x: (x["slug"] != "") & (F.lower(x["slug"]) != own))
    best = F.coalesce(F.get(F.filter(kept, lambda x: x["top"]), F.lit(0)), F.get(kept, F.lit(0)))
    return F.coalesce(best["slug"], F.lit(""))


def redirect_target(text: Column, skip_host: str) -> Column:
    """First link of a page whose host is not in the skip pattern."""
    kept = F.filter(ux.links(text), lambda u: (ux.host(u) != "") & ~ux.host(u).rlike(skip_host))
    return F.coalesce(F.try_element_at(kept, F.lit(1)), F.lit(""))


#: Stands in a rule table for any host.
ANY_HOST = "*"


def _with_rules(rows: DataFrame, host: Column, rules: DataFrame) -> DataFrame:
    """Rows beside every rule of their host, and those for any host."""
    keyed = rows.withColumn("rule_host", F.explode(F.array_distinct(F.array(F.lower(host), F.lit(ANY_HOST)))))
    return keyed.join(rules.withColumn("rule_host", F.lower("host")).drop("host"), "rule_host").drop("rule_host")


def cards_by_rules(pages: DataFrame, rules: DataFrame, host: Column) -> DataFrame:
    """``page_id, pos, rule, fields`` of the repeating cards of each page by a table of rules: the first card of each page, rule and reference that
    has every field.

    ``rules``: rule, host (or ``*``), card (pattern of a whole card), fields (map of a field's name to a pattern with one group), ref (the name of the
    field that tells cards apart). Rules are data: a new site is a new row, and pages meet only the rules of their host."""
    found = _with_rules(pages.select("page_id", "html", host.alias("_h")), F.col("_h"), rules).select(
        "page_id", "rule", "fields", "ref", F.posexplode(F.expr("regexp_extract_all(html, card, 0)")).alias("pos", "_card"))
    values = F.expr("transform_values(fields, (name, pattern) -> regexp_extract(_card, pattern, 1))")
    read = found.select("page_id", "pos", "rule", "ref", values.alias("_raw")).select(
        "page_id", "pos", "rule", "ref", F.transform_values("_raw", lambda _, v: hx.to_text(v)).alias("fields"))
    whole = read.where(F.forall(F.map_values("fields"), lambda v: v != "")).withColumn("_ref", F.element_at(F.col("fields"), F.col("ref")))
    return keep_first(whole, ["page_id", "rule", "_ref"], [F.col("pos")]).select("page_id", "pos", "rule", "fields")


def links_by_rules(anchors: DataFrame, rules: DataFrame, host: Column) -> DataFrame:
    """``extract_by_link_rules`` by a table: of the rules of its host, or of any, an anchor takes the first (by ``rule``) whose pattern its address
    fits.

    ``rules``: rule, host, source, pattern (one group: the reference), company, place, place_pattern, skip."""
    met = _with_rules(anchors.withColumn("_h", host), F.col("_h"), rules).where(F.expr("href RLIKE pattern")).drop("_h")
    first = keep_first(met, ["page_id", "pos"], [F.col("rule")])
    rows = first.where(F.length("label").between(4, 160) & ~F.expr("label RLIKE skip")).select(
        "page_id", "pos", "source", F.col("label").alias("title"), F.expr("regexp_extract(href, pattern, 1)").alias("ref"), "company",
        F.coalesce(F.nullif(F.expr("regexp_extract(label, place_pattern, 1)"), F.lit("")), F.col("place")).alias("location"), F.split("href", r"\?")[0].alias("url"))
    return keep_first(rows, ["source", "ref"], [F.col("page_id"), F.col("pos")])
