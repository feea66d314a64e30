"""URL parts, canonical keys, link classes and address guards."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossierflow.functions.text import col, q_str

SCHEME_HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)"
PATH = r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)"
QUERY = r"\?([^#]*)"
PORT = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?[^/:?#]+:([0-9]+)"
LINK = r"""https?://[^\s<>"')\]]+"""
BARE_DOMAIN = r"(?i)^[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)+(?::[0-9]+)?(?:[/?#]\S*)?$"
SEARCH_PATH = r"/jobs/search(?:$|[^a-z0-9_])|/jobs/?$|/(?:search|find-jobs|browse|category)(?:$|[^a-z0-9_])"
SEARCH_QUERY = r"keywords=|q=|search="


def host(u) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(col(u), SCHEME_HOST, 1)), r"^www\.", "")


def path(u) -> Column:
    return F.regexp_extract(col(u), PATH, 1)


def query_string(u) -> Column:
    return F.regexp_extract(col(u), QUERY, 1)


def host_suffixes(h) -> Column:
    """``a.b.c`` -> ``[a.b.c, b.c, c]``: turns "equal or subdomain of" into an equi join."""
    parts = F.split(col(h), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)),
                       lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def rank_key(u) -> Column:
    return F.lower(F.regexp_replace(F.split(col(u), r"\?")[0], r"/+$", ""))


def store_key(u) -> Column:
    s = F.regexp_replace(F.lower(F.trim(col(u))), r"^https?://(?:www\.)?", "")
    return F.regexp_replace(F.regexp_replace(s, r"#.*$", ""), r"/+$", "")


def agent_key(u, title) -> Column:
    return F.concat(F.lower(F.split(col(u), r"\?")[0]), F.lit("|"), F.lower(col(title)))


def resolve(href, base) -> Column:
    """Absolute address of a link; the fragment is dropped."""
    h, b = col(href), col(base)
    origin = F.regexp_extract(b, r"(?i)^([a-z][a-z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_extract(b, r"(?i)^([a-z][a-z0-9+.-]*://[^/?#]+(?:/[^?#]*/)?)", 1)
    absolute = (F.when(h.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), h)
                .when(h.startswith("//"), F.concat(F.regexp_extract(b, r"(?i)^([a-z][a-z0-9+.-]*:)", 1), h))
                .when(h.startswith("/"), F.concat(origin, h))
                .otherwise(F.concat(F.regexp_replace(folder, r"/+$", ""), F.lit("/"), h)))
    return F.split(absolute, "#")[0]


def first_source(u, rules: list[tuple[str, str]]) -> Column:
    """First matching fragment in priority order, else the text itself, else ``websearch``."""
    low = F.lower(col(u))
    out = None
    for fragment, source in rules:
        out = (out if out is not None else F).when(F.contains(low, F.lit(fragment)), F.lit(source))
    return out.otherwise(F.coalesce(F.nullif(low, F.lit("")), F.lit("websearch")))


def is_search_page(u) -> Column:
    return F.lower(path(u)).rlike(SEARCH_PATH) | F.lower(query_string(u)).rlike(SEARCH_QUERY)


def links(c) -> Column:
    """Distinct http links of a text, trailing punctuation cut, the misread short-link host repaired."""
    found = F.regexp_extract_all(col(c), F.lit(LINK), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(
        F.regexp_replace(u, r"[.,;:]+$", ""), r"^(https?://)Inkd\.in/", "$1lnkd.in/")))


def is_public_http(u) -> Column:
    """http(s) on a standard port to a name or a public address literal (no name resolution)."""
    h = F.lower(F.regexp_extract(col(u), SCHEME_HOST, 1))
    port = F.regexp_extract(col(u), PORT, 1)
    octets = F.split(h, r"\.")
    is_v4 = h.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")
    a, b = F.try_element_at(octets, F.lit(1)).try_cast("int"), F.try_element_at(octets, F.lit(2)).try_cast("int")
    private_v4 = (a.isin(0, 10, 127) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254))
                  | ((a == 172) & b.between(16, 31)) | ((a == 192) & b.isin(0, 168))
                  | ((a == 198) & b.isin(18, 19)) | (a >= 224))
    return F.coalesce(
        col(u).rlike(r"(?i)^https?://") & (h != "") & port.isin("", "80", "443")
        & ~h.rlike(r"^localhost$|\.(?:local|internal|localhost)$") & ~h.startswith("[")
        & ~(is_v4 & private_v4), F.lit(False))


def query_value(u, name: str) -> Column:
    return F.regexp_extract(query_string(u), rf"(?:^|&){name}=([^&]*)", 1)


# Check SQL twins.
def q_host(u: str) -> str:
    return rf"regexp_replace(lower(regexp_extract({u}, {q_str(SCHEME_HOST)}, 1)), '^www\.', '')"


def q_path(u: str) -> str:
    return f"regexp_extract({u}, {q_str(PATH)}, 1)"


def q_query(u: str) -> str:
    return f"regexp_extract({u}, {q_str(QUERY)}, 1)"


def q_resolve_root(href: str, base: str) -> str:
    """Twin of :func:`resolve` for root-relative and absolute links (all the given pages have)."""
    return (f"split_part(CASE WHEN regexp_matches({href}, '(?i)^[a-z][a-z0-9+.-]*:') THEN {href} "
            f"ELSE regexp_extract({base}, '(?i)^([a-z][a-z0-9+.-]*://[^/?#]+)', 1) || {href} END, '#', 1)")


def q_first_source(u: str, rules) -> str:
    arms = " ".join(f"WHEN contains(lower({u}), {q_str(f)}) THEN {q_str(s)}" for f, s in rules)
    return f"CASE {arms} ELSE coalesce(nullif(lower({u}), ''), 'websearch') END"
