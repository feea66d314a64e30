"""Month-level dates: reading printed dates and ranges, month indices, display, horizons."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossierflow.functions.text import MONTH_WORDS, OPEN_WORDS, col, fold_digits, let, squeeze

_MONTH = "|".join(sorted((w for ws in MONTH_WORDS.values() for w in ws), key=len, reverse=True))
_OPEN = "|".join(sorted(OPEN_WORDS, key=len, reverse=True))
SIDE = (rf"(?:[0-9]{{1,2}}\s*[-/.]\s*[0-9]{{4}}|[0-9]{{4}}\s*[-/.]\s*[0-9]{{1,2}}|(?:{_MONTH})\.?,?\s+[0-9]{{4}}|[0-9]{{4}})")
DASH_RANGE = rf"(?iu)^({SIDE})\s*([–—-]+)\s*({SIDE}|{_OPEN})?$"
WORD_RANGE = rf"(?iu)^({SIDE})\s+(to|bis|until|till|à|a|al|au|hasta)\s+({SIDE}|{_OPEN})$"
SINCE = rf"(?iu)^(since|from|seit|depuis|desde|dal)\s+({SIDE})$"
SIDE_TYPE = "struct<y:int,m:int,fmt:string,is_open:boolean>"


def _month_number(word: Column) -> Column:
    table = F.create_map(*[F.lit(x) for n, ws in MONTH_WORDS.items() for w in ws for x in (w, n)])
    return F.try_element_at(table, F.regexp_replace(F.lower(word), r"[.,\s]+$", ""))


def _int(c: Column) -> Column:
    return F.nullif(c, F.lit("")).cast("int")


def _side(y: Column, m: Column, fmt: str, is_open: bool = False) -> Column:
    return F.struct(y.alias("y"), m.alias("m"), F.lit(fmt).alias("fmt"), F.lit(is_open).alias("is_open")).cast(SIDE_TYPE)


def _open_side() -> Column:
    null = F.lit(None).cast("int")
    return _side(null, null, "open", True)


def parse_side(c) -> Column:
    """One side of a range: MM/YYYY, ISO, month name and year, year alone, or an open word; NULL when unreadable."""
    return let(F.regexp_replace(squeeze(fold_digits(c)), r"^[\s.,;:()\[\]]+|[\s.,;:()\[\]]+$", ""), _read_side)


def _read_side(s: Column) -> Column:
    numeric, iso, named = r"^([0-9]{1,2})\s*[-/.]\s*([0-9]{4})$", r"^([0-9]{4})\s*[-/.]\s*([0-9]{1,2})$", r"^(\S.*?)[.,]?\s+([0-9]{4})$"
    nm, im = _int(F.regexp_extract(s, numeric, 1)), _int(F.regexp_extract(s, iso, 2))
    word = _month_number(F.regexp_extract(s, named, 1))
    year = _int(F.regexp_extract(s, r"^([0-9]{4})$", 1))
    return (F.when(F.lower(s).isin(*OPEN_WORDS), _open_side())
            .when(nm.between(1, 12), _side(_int(F.regexp_extract(s, numeric, 2)), nm, "MM/YYYY"))
            .when(im.between(1, 12), _side(_int(F.regexp_extract(s, iso, 1)), im, "MM/YYYY"))
            .when(word.isNotNull(), _side(_int(F.regexp_extract(s, named, 2)), word, "Mon YYYY"))
            .when(year.between(1950, 2039), _side(year, F.lit(None).cast("int"), "YYYY")))


def parse_range(c) -> Column:
    """``from``/``to`` sides, separator, bracketed note, single and dangling flags; NULL sides when unreadable."""
    return let(fold_digits(c), lambda folded: let(squeeze(F.regexp_replace(folded, r"\([^)]*\)", " ")), lambda s: _read_range(
        s, F.array_join(F.transform(F.regexp_extract_all(folded, F.lit(r"\(([^)]*)\)"), F.lit(1)), lambda x: F.trim(x)), "; "))))


def _read_range(s: Column, note: Column) -> Column:
    x = lambda pattern, g: F.regexp_extract(s, pattern, g)
    shape = (F.when(s.rlike(SINCE), "since").when(s.rlike(DASH_RANGE), F.when(x(DASH_RANGE, 3) == "", "dangling").otherwise("dash"))
             .when(s.rlike(WORD_RANGE), "word").otherwise("single"))

    def cut(shape: Column) -> Column:
        left = (F.when(shape == "since", x(SINCE, 2)).when(shape.isin("dash", "dangling"), x(DASH_RANGE, 1))
                .when(shape == "word", x(WORD_RANGE, 1)).otherwise(s))
        right = F.when(shape == "dash", x(DASH_RANGE, 3)).when(shape == "word", x(WORD_RANGE, 3))
        sep = (F.when(shape == "since", x(SINCE, 1)).when(shape.isin("dash", "dangling"), x(DASH_RANGE, 2)).when(shape == "word", x(WORD_RANGE, 2)))
        return F.struct(shape.alias("shape"), parse_side(left).alias("a"), parse_side(right).alias("b"), sep.alias("sep"))

    def assemble(p: Column) -> Column:
        one = p["shape"].isin("single", "dangling")
        end = F.when(p["shape"] == "since", _open_side()).when(one, p["a"]).otherwise(p["b"])
        ok = p["a"].isNotNull() & ~p["a"]["is_open"] & end.isNotNull()
        return F.struct(F.when(ok, p["a"]).alias("from"), F.when(ok, end).alias("to"), F.when(ok, p["sep"]).alias("sep"), note.alias("note"),
                        (ok & one).alias("single"), (ok & (p["shape"] == "dangling")).alias("dangling"))

    return let(let(shape, cut), assemble)


def month_ix(y, m) -> Column:
    return (col(y) * 12 + col(m) - 1).cast("int")


def early_ix(side: Column, today_ix: int) -> Column:
    """Conservative start: a year alone is January; an open side is today."""
    return F.when(side["is_open"], F.lit(today_ix)).otherwise(month_ix(side["y"], F.coalesce(side["m"], F.lit(1))))


def late_ix(side: Column, today_ix: int) -> Column:
    return F.when(side["is_open"], F.lit(today_ix)).otherwise(month_ix(side["y"], F.coalesce(side["m"], F.lit(12))))


def generous_bounds(frm: Column, to: Column, today_ix: int) -> tuple[Column, Column]:
    """Overlap reading: a year-only start is December, a year-only end is January."""
    return late_ix(frm, today_ix), early_ix(to, today_ix)


def latest_past(day_month: Column, read_on: Column) -> Column:
    """``12 Mar`` without a year: the latest such date not after ``read_on``."""
    month = _month_number(F.regexp_extract(day_month, r"^\s*[0-9]{1,2}\s+(\p{L}{3})", 1))
    day = _int(F.regexp_extract(day_month, r"^\s*([0-9]{1,2})", 1))
    this = F.try_make_date(F.year(read_on), month, day) if hasattr(F, "try_make_date") else F.make_date(F.year(read_on), month, day)
    return F.when(this > read_on, F.add_months(this, -12)).otherwise(this)


def export_month(c) -> Column:
    """Export dates (``Jan 2019``, ``2019``, ``2019-01``, ``01/2019``, ``Sept 2019``) to ``Mon YYYY`` or ``YYYY``."""
    def show(side: Column) -> Column:
        stamp = F.make_date(side["y"], F.coalesce(side["m"], F.lit(1)), F.lit(1))
        return (F.when(side.isNull() | side["is_open"], F.trim(col(c))).when(side["m"].isNull(), side["y"].cast("string"))
                .otherwise(F.date_format(stamp, "MMM yyyy")))

    return let(parse_side(c), show)


def end_year(c) -> Column:
    """Last year printed; 9999 for a present-day end; 0 for none."""
    years = F.transform(F.regexp_extract_all(col(c), F.lit(r"(?:19|20)[0-9]{2}"), F.lit(0)), lambda y: y.cast("int"))
    return F.when(F.lower(col(c)).rlike(r"(?U)\b(?:present|heute|current|today|now|aktuell|laufend)\b"), F.lit(9999)).otherwise(
        F.coalesce(F.array_max(years), F.lit(0)))


def display_range(frm: Column, to: Column, market: Column) -> Column:
    """``Mar 2005 – Jan 2008``; the DACH market writes ``03/2005 – 01/2008``."""
    return F.when(market == "dach", F.concat(F.date_format(frm, "MM/yyyy"), F.lit(" – "), F.date_format(to, "MM/yyyy"))).otherwise(
        F.concat(F.date_format(frm, "MMM yyyy"), F.lit(" – "), F.date_format(to, "MMM yyyy")))


def read_horizon(oldest_open: Column, today: Column) -> Column:
    """From one day before the oldest open record or 30 days back, whichever is earlier, at most 120 days back."""
    base = F.date_sub(today, 30)
    return F.greatest(F.least(F.coalesce(F.date_sub(oldest_open, 1), base), base), F.date_sub(today, 120))


def follow_up_due(sent: Column, days: int = 4) -> Column:
    """Day on which an unanswered record is due for a follow-up."""
    return F.date_add(F.to_date(sent), days)


def range_flag(frm: Column, to: Column, today: Column) -> Column:
    """``unreadable`` where a side is missing, ``reversed`` where the end lies before the start, ``future`` where the start lies after today."""
    return (F.when(frm.isNull() | to.isNull(), "unreadable").when(to < frm, "reversed").when(frm > today, "future"))
