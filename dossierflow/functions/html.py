"""Markup to text: tags, entities, lines, anchors, cards, embedded JSON and feeds."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossierflow.functions.text import col, q_squeeze, q_str, squeeze, strip

# Named entities, decoded in this order.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#039;", "'"),
            ("&apos;", "'"), ("&nbsp;", " "))
ANCHOR = r"""(?is)<a\s[^>]*?href=["'][^"']+["'][^>]*>.*?</a>"""
ANCHOR_PARTS = r"""(?is)<a\s[^>]*?href=["']([^"']+)["'][^>]*>(.*?)</a>"""
MARKDOWN_LINK = r"\[[^\]\n]{4,180}\]\(https?://[^\s)]+\)"
JSON_LD = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""


def _codepoint(hex_digits: Column) -> Column:
    return F.decode(F.unhex(F.lpad(hex_digits, 8, "0")), "UTF-32")


def _decode_numeric(c: Column) -> Column:
    dec = F.array_distinct(F.regexp_extract_all(c, F.lit(r"&#([0-9]{1,6});"), F.lit(1)))
    hexa = F.array_distinct(F.regexp_extract_all(c, F.lit(r"&#[xX]([0-9a-fA-F]{1,5});"), F.lit(1)))
    out = F.aggregate(dec, c, lambda acc, d: F.replace(
        acc, F.concat(F.lit("&#"), d, F.lit(";")), _codepoint(F.hex(d.cast("int")))))
    return F.aggregate(hexa, out, lambda acc, h: F.replace(
        F.replace(acc, F.concat(F.lit("&#x"), h, F.lit(";")), _codepoint(h)),
        F.concat(F.lit("&#X"), h, F.lit(";")), _codepoint(h)))


def decode_entities(c) -> Column:
    out = col(c)
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.when(F.contains(out, F.lit("&#")), _decode_numeric(out)).otherwise(out)


def to_text(c) -> Column:
    """Tags out, entities decoded, whitespace collapsed."""
    return squeeze(decode_entities(F.regexp_replace(col(c), r"<[^>]+>", " ")))


def to_lines(c) -> Column:
    """Readable lines: block ends become line ends, list items get a bullet, scripts and styles go."""
    s = F.regexp_replace(col(c), r"(?is)<script.*?</script>", " ")
    s = F.regexp_replace(s, r"(?is)<style.*?</style>", " ")
    s = F.regexp_replace(s, r"""(?is)<a\s[^>]*href="mailto:([^"?]+)[^"]*"[^>]*>(.*?)</a>""", "$2 $1")
    s = F.regexp_replace(s, r"(?i)<br\s*/?>|</(?:p|li|ul|ol|div|h[0-9]|tr|section|article)>", "\n")
    s = F.regexp_replace(s, r"(?i)<li(?:\s[^>]*)?>", "• ")
    s = decode_entities(F.regexp_replace(s, r"<[^>]+>", " "))
    rows = F.transform(F.split(s, r"\r?\n"), lambda x: strip(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.array_join(F.filter(rows, lambda x: x != ""), "\n")


def first_tag(c, tag: str) -> Column:
    """Text of the first element of a kind, NULL when absent or blank."""
    return F.nullif(to_text(F.regexp_extract(col(c), rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)), F.lit(""))


def anchors(c) -> Column:
    """Array of whole anchor elements in page order."""
    return F.regexp_extract_all(col(c), F.lit(ANCHOR), F.lit(0))


def anchor_href(a) -> Column:
    return strip(F.regexp_extract(col(a), ANCHOR_PARTS, 1))


def anchor_label(a) -> Column:
    return to_text(F.regexp_extract(col(a), ANCHOR_PARTS, 2))


def json_ld_blocks(c) -> Column:
    return F.regexp_extract_all(col(c), F.lit(JSON_LD), F.lit(1))


# Check SQL twins.
def q_decode(x: str) -> str:
    for name, char in ENTITIES:
        x = f"replace({x}, {q_str(name)}, {q_str(char)})"
    return x


def q_to_text(x: str) -> str:
    return q_squeeze(q_decode(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"))


def q_to_lines(x: str) -> str:
    s = rf"regexp_replace({x}, '(?is)<script.*?</script>', ' ', 'g')"
    s = rf"regexp_replace({s}, '(?is)<style.*?</style>', ' ', 'g')"
    s = rf"""regexp_replace({s}, '(?is)<a\s[^>]*href="mailto:([^"?]+)[^"]*"[^>]*>(.*?)</a>', '\2 \1', 'g')"""
    s = rf"regexp_replace({s}, '(?i)<br\s*/?>|</(?:p|li|ul|ol|div|h[0-9]|tr|section|article)>', chr(10), 'g')"
    s = rf"regexp_replace({s}, '(?i)<li(?:\s[^>]*)?>', '• ', 'g')"
    s = q_decode(rf"regexp_replace({s}, '<[^>]+>', ' ', 'g')")
    row = r"regexp_replace(regexp_replace(l_, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
    return (rf"array_to_string(list_filter(list_transform(regexp_split_to_array({s}, '\r?\n'), lambda l_: {row}), "
            rf"lambda l_: l_ <> ''), chr(10))")


def q_first_tag(x: str, tag: str) -> str:
    inner = f"regexp_extract({x}, '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1)"
    return f"nullif({q_to_text(inner)}, '')"


Q_ANCHORS = rf"""anchors AS (
  SELECT page_id, url, (ix - 1)::INT AS pos,
         regexp_replace(regexp_extract(a, {q_str(ANCHOR_PARTS)}, 1), '^\s+|\s+$', '', 'g') AS raw_href,
         {q_to_text(f"regexp_extract(a, {q_str(ANCHOR_PARTS)}, 2)")} AS label
  FROM pages, unnest(regexp_extract_all(html, {q_str(ANCHOR)})) WITH ORDINALITY AS u(a, ix))"""
