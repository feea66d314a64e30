"""Month intervals per key: merging, gaps, overlaps, recency, sliding counts.

A hot key is pre-aggregated on its month values (a bounded domain) before any window, or ranked in buckets.
"""
from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossierflow.functions import text as tx
from dossierflow.operators.scale import bucketed_rank, top_k

NO_WORD, WORDS = regex.compile(r"[^\p{L}\p{N}]"), regex.compile("[^ ]+")
SPAN = 65_536  # rows of stored positions per rank bucket


def merge_intervals(roles: DataFrame, key: str, slack: int = 1) -> DataFrame:
    """Union of [from_ix, to_ix] per key; neighbours within ``slack`` months join. One row per island.
    Rows are first reduced to one per (key, start month)."""
    starts = roles.groupBy(key, "from_ix").agg(F.max("to_ix").alias("to_ix"))
    w = W.partitionBy(key).orderBy("from_ix")
    reach = F.max("to_ix").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = starts.withColumn("_new", F.when(F.col("from_ix") <= reach + slack, 0).otherwise(1))
    return (marked.withColumn("island", F.sum("_new").over(w).cast("int"))
            .groupBy(key, "island").agg(F.min("from_ix").alias("from_ix"), F.max("to_ix").alias("to_ix")))


def timeline_gaps(roles: DataFrame, key: str, today_ix: int, minimum: int = 6, serious: int = 12, is_open: Column | None = None) -> DataFrame:
    """Empty months between islands, and from the last end to today when no role is open."""
    islands = merge_intervals(roles, key)
    w = W.partitionBy(key).orderBy("from_ix")
    nxt = islands.withColumn("_next", F.lead("from_ix").over(w))
    if is_open is not None:
        nxt = nxt.join(roles.groupBy(key).agg(F.bool_or(is_open).alias("_open")), key)
    trailing = F.col("_next").isNull() & (~F.col("_open") if is_open is not None else F.lit(True))
    gap_to = F.when(F.col("_next").isNotNull(), F.col("_next") - 1).when(trailing & (today_ix - F.col("to_ix") >= minimum), F.lit(today_ix))
    gaps = nxt.select(key, (F.col("to_ix") + 1).alias("gap_from"), gap_to.cast("int").alias("gap_to"), F.col("_next").isNull().alias("trailing"))
    months = F.col("gap_to") - F.col("gap_from") + 1
    return (gaps.where(F.col("gap_to").isNotNull() & (months >= minimum))
            .withColumn("months", months).withColumn("sev", F.when(months > serious, "med").otherwise("low")))


def overlap_counts(roles: DataFrame, key: str, role: str, min_months: int = 2) -> DataFrame:
    """Per role: how many other roles of the key share at least ``min_months`` months with it.

    Counts come from running totals of start and end months per key, so no pair of roles is ever formed.
    """
    d = min_months - 1
    long = roles.where(F.col("to_ix") - F.col("from_ix") >= d)
    distinct = long.groupBy(key, "from_ix", "to_ix").agg(F.count(F.lit(1)).alias("_n"))
    zero = F.lit(0).cast("long")
    mark = lambda m, s, e, ask: F.struct(m.alias("m"), s.alias("s"), e.alias("e"), F.lit(ask).alias("ask"))
    marks = distinct.select(key, "from_ix", "to_ix", F.explode(F.array(
        mark(F.col("from_ix"), F.col("_n"), zero, ""), mark(F.col("to_ix") + 1, zero, F.col("_n"), ""),
        mark(F.col("to_ix") - d, zero, zero, "started"), mark(F.col("from_ix") + d, zero, zero, "ended"))).alias("x"))
    w = W.partitionBy(key).orderBy("x.m").rangeBetween(W.unboundedPreceding, 0)
    totals = marks.select(key, "from_ix", "to_ix", "x.ask", F.sum("x.s").over(w).alias("started"), F.sum("x.e").over(w).alias("ended"))
    per = (totals.where("ask <> ''").groupBy(key, "from_ix", "to_ix")
           .agg((F.max(F.when(F.col("ask") == "started", F.col("started"))) - F.max(F.when(F.col("ask") == "ended", F.col("ended"))) - 1).alias("n_overlaps"))
           .where("n_overlaps > 0"))
    return long.join(per, [key, "from_ix", "to_ix"]).select(key, role, "from_ix", "to_ix", "n_overlaps")


# Words that say a role ran beside another, and titles that always may.
PARALLEL_WORDS = ("alongside", "at the same time", "concurrent", "concurrently", "en parallèle", "freelance", "in parallel", "nebenberuflich", "non-executive", "parallel",
                  "parallel zu", "part-time", "simultaneous", "simultaneously", "teilzeit", "zeitgleich")
PART_TITLES = ("board member", "freelance", "nebenberuflich", "non-executive", "part-time", "teilzeit")


def unexplained_overlaps(roles: DataFrame, key: str, role: str, free_words: tuple[str, ...] = ("and", "with", "from")) -> DataFrame:
    """Per role that shares two months or more with others of its key without a note: ``n_overlaps`` and ``partner``, the smallest id among them.

    ``roles``: key, role, from_ix, to_ix (coarse years already read generously), title, employer, note (what stands beside the dates). A
    part-time title overlaps nothing. A note, or title, that says the role ran in parallel explains the pair with every role it names, by the
    employer or by a longer word of the title.

    Two roles share two months if both cover some pair of neighbouring months, so roles meet at such cells, of which a key has as many as
    its calendar. A cell holds a count and its smallest ids; only roles with a note are paired, with the roles they name."""
    said = F.concat_ws(" ", "note", "title")
    names = F.array_distinct(F.concat(F.array(tx.norm("employer")), F.filter(tx.letter_words("title"), lambda w: (F.length(w) >= 4) & ~w.isin(*free_words))))
    rows = (roles.where((F.col("to_ix") > F.col("from_ix")) & ~tx.has_term(F.coalesce("title", F.lit("")), PART_TITLES))
            .select(key, F.col(role).alias("id"), "from_ix", "to_ix", F.filter(names, lambda n: n != "").alias("names"), tx.norm(said).alias("said"),
                    tx.has_term(said, PARALLEL_WORDS).alias("noted")))
    counts = overlap_counts(rows, key, "id")
    # notes meet names by the name's first word
    start = lambda c: F.get(F.split(c, " "), F.lit(0))
    noted = rows.where("noted").select(key, F.col("id").alias("a"), F.col("from_ix").alias("af"), F.col("to_ix").alias("at"), "said",
                                       F.explode(F.array_distinct(F.split("said", " "))).alias("w"))
    named = rows.select(key, F.col("id").alias("b"), "from_ix", "to_ix", F.explode("names").alias("name")).withColumn("w", start(F.col("name")))
    pairs = (noted.join(named, [key, "w"]).where((F.col("a") != F.col("b")) & (F.least("at", "to_ix") - F.greatest("af", "from_ix") >= 1)
                                                 & F.contains(F.concat(F.lit(" "), "said", F.lit(" ")), F.concat(F.lit(" "), "name", F.lit(" ")))).select(key, "a", "b"))
    explained = pairs.unionByName(pairs.select(key, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    spared = explained.groupBy(key, F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("_spared"))
    open_ = (counts.join(spared, [key, "id"], "left").withColumn("n_overlaps", F.col("n_overlaps") - F.coalesce("_spared", F.lit(0)))
             .where("n_overlaps > 0").select(key, "id", "from_ix", "to_ix", "n_overlaps", F.col("_spared").isNotNull().alias("_some")))
    cells = rows.select(key, "id", F.explode(F.sequence("from_ix", F.col("to_ix") - 1)).alias("cell"))
    least = cells.groupBy(key, "cell").agg(F.min("id").alias("_one"))
    second = cells.join(least, [key, "cell"]).where(F.col("id") != F.col("_one")).groupBy(key, "cell").agg(F.min("id").alias("_two"))
    smallest = least.join(second, [key, "cell"])
    mine = open_.select(key, "id", "_some", F.explode(F.sequence("from_ix", F.col("to_ix") - 1)).alias("cell"))
    plain = (mine.where("NOT _some").join(smallest, [key, "cell"])
             .groupBy(key, "id").agg(F.min(F.when(F.col("_one") == F.col("id"), F.col("_two")).otherwise(F.col("_one"))).alias("partner")))
    # a role that some note explains looks at all that share its cells
    other = cells.select(key, "cell", F.col("id").alias("b"))
    careful = (mine.where("_some").join(other, [key, "cell"]).where(F.col("b") != F.col("id")).select(key, F.col("id").alias("a"), "b")
               .join(explained, [key, "a", "b"], "left_anti").groupBy(key, F.col("a").alias("id")).agg(F.min("b").alias("partner")))
    return (open_.join(plain.unionByName(careful), [key, "id"])
            .select(key, F.col("id").alias(role), "from_ix", "to_ix", "n_overlaps", "partner"))


def covered_years(roles: DataFrame, key: str, today_ix: int, is_open: Column) -> DataFrame:
    """Career span: first start to today when a role is open, else to the last end; whole years."""
    agg = roles.groupBy(key).agg(F.min("from_ix").alias("_s"), F.max("to_ix").alias("_e"), F.bool_or(is_open).alias("_o"))
    months = F.greatest(F.lit(0), F.when(F.col("_o"), F.lit(today_ix)).otherwise(F.col("_e")) - F.col("_s")).cast("int")
    return agg.select(key, months.alias("months"), F.floor(months / 12).cast("int").alias("years"))


def bucketed_last(df: DataFrame, keys: list[str], pos: str, value: Column, name: str, span: int = SPAN) -> DataFrame:
    """Last non-null ``value`` strictly before each row in stored order, carried over bucket edges."""
    rows = df.withColumn("_b", F.floor(F.col(pos) / span)).withColumn("_v", value)
    edge = rows.groupBy(*keys, "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(pos))).alias("_edge"))
    wb = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = edge.select(*keys, "_b", F.last("_edge", ignorenulls=True).over(wb).alias("_carry"))
    wl = W.partitionBy(*keys, "_b").orderBy(pos).rowsBetween(W.unboundedPreceding, -1)
    return (rows.withColumn("_l", F.last("_v", ignorenulls=True).over(wl))
            .join(carried, keys + ["_b"])
            .withColumn(name, F.coalesce("_l", "_carry")).drop("_b", "_v", "_l", "_carry"))


def recency_rank(roles: DataFrame, key: str, pos: str, rank: str = "recency") -> DataFrame:
    """0 for the newest: latest end, then latest start, then stored position. A role without readable dates
    (NULL from_ix) follows the last readable one stored before it, the later stored first."""
    readable = F.when(F.col("from_ix").isNotNull(), F.struct(F.col("to_ix").alias("t"), F.col("from_ix").alias("f"), F.col(pos).alias("p")))
    withprev = bucketed_last(roles, [key], pos, readable, "_prev")
    a = withprev.withColumn("_a", F.coalesce(readable, F.col("_prev")))
    odd = F.col("from_ix").isNull()
    order = [F.col("_a").isNotNull(), -F.col("_a.t"), -F.col("_a.f"), F.col("_a.p"), odd, F.when(odd, -F.col(pos))]
    # one bucket per end month: the counts of a key are as many as its months, not as its rows
    bucket = F.struct(F.col("_a").isNotNull().alias("h"), (-F.col("_a.t")).alias("t"))
    return bucketed_rank(a, [key], bucket, order, "_rk").withColumn(rank, F.col("_rk") - 1).drop("_rk", "_a", "_prev")


def out_of_order(rows: DataFrame, keys: list[str], pos: str, end: Column) -> DataFrame:
    """Rows stored directly below a row that ended earlier."""
    prev = bucketed_last(rows.withColumn("_end", end), keys, pos, F.struct(F.col("_end").alias("e"), F.col(pos).alias("p")), "_prev")
    return prev.where(F.col("_prev.e") < F.col("_end")).withColumn("above", F.col("_prev.p")).drop("_end", "_prev")


def count_band(ranked: DataFrame, rank: str, count: str) -> DataFrame:
    """Line-count target by recency: 4-6 for the newest, 2-4 for the next two, at most 3 after."""
    r, n = F.col(rank), F.col(count)
    low = F.when(r == 0, 4).when(r <= 2, 2).otherwise(0)
    high = F.when(r == 0, 6).when(r <= 2, 4).otherwise(3)
    return (ranked.withColumn("sev", F.when((r <= 2) & (n == 0), "med").when((n < low) | (n > high), "low"))
            .where(F.col("sev").isNotNull()))


def trailing_rate(events: DataFrame, keys: list[str], ts: str, ident: str, n: int, seconds: int, with_opening: bool = False) -> DataFrame:
    """Number of earlier events of the key in the trailing window, and whether the event is over the limit.

    Each event is also placed in the next time bucket as context, so a window needs one (key, bucket) group only.
    ``with_opening`` adds whether no event at an earlier instant lies in the window."""
    sec = F.unix_micros(F.col(ts).cast("timestamp"))
    width = seconds * 1_000_000
    rows = events.withColumn("_t", sec).withColumn("_b0", F.floor(sec / width))
    spread = rows.withColumn("_b", F.explode(F.array(F.col("_b0"), F.col("_b0") + 1)))
    w = W.partitionBy(*keys, "_b").orderBy("_t").rangeBetween(-(width - 1), 0)
    counted = spread.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_b") == F.col("_b0"))
    # events at the same instant are ordered by id, so only lower ids count as earlier
    same = W.partitionBy(*keys, "_b", "_t").orderBy(F.col(ident).desc())
    earlier = F.col("_n") - F.row_number().over(same)
    extra = []
    if with_opening:
        instant = F.count(F.lit(1)).over(W.partitionBy(*keys, "_b", "_t"))
        extra = [(F.col("_n") == instant).alias("opening")]
    return counted.select(*events.columns, earlier.cast("int").alias("n_before"), (earlier >= n).alias("rejected"), *extra)


def weakest_lines(lines: DataFrame, key: str, k: int = 3) -> DataFrame:
    """Lines of the three newest roles: newest role, most reasons, first position."""
    return top_k(lines.where("recency < 3 AND n_reasons > 0"), [key], [F.col("recency"), F.col("n_reasons").desc(), F.col("pos")], k)


def first_by_priority(rows: DataFrame, keys: list[str], value: str, priority: str) -> DataFrame:
    return rows.where(F.trim(F.coalesce(value, F.lit(""))) != "").groupBy(*keys).agg(F.min_by(value, priority).alias(value))


def term_hits(text: str, terms: dict[str, list[tuple[str, int]]]) -> list[tuple[int, int, int]]:
    """``(start, end, rank)`` of every term in a text, in one pass over its words. ``terms``: by first word, the whole terms with their ranks. A
    term of several words stands with one other character between them."""
    low, out = text.lower(), []
    plain = NO_WORD.sub(" ", low)
    for m in WORDS.finditer(plain):
        for term, rank in terms.get(m[0], ()):
            end = m.start() + len(term)
            if plain.startswith(term, m.start()) and (end == len(plain) or plain[end] == " "):
                out.append((m.start(), end, rank))
    return out


def apart(hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Hits that do not overlap, by start: the longest first, then the earliest, then by rank. What is kept lies in order, so a hit looks at
    its two neighbours only."""
    kept: list[tuple[int, int, int]] = []
    for hit in sorted(hits, key=lambda h: (h[0] - h[1], h[0], h[2])):
        k = bisect(kept, hit)
        if (not k or kept[k - 1][1] <= hit[0]) and (k == len(kept) or hit[1] <= kept[k][0]):
            kept.insert(k, hit)
    return kept


def strongest_in(texts: DataFrame, key: str, text: str, patterns: list[str]) -> DataFrame:
    """``key, start, end, rank`` of the non-overlapping hits of lower-case terms in each text (``rank``: place in ``patterns``), whatever their
    number: all terms are looked up in one pass over the words."""
    by_first: dict[str, list[tuple[str, int]]] = {}
    for rank, term in enumerate(patterns):
        by_first.setdefault(term.split(" ")[0], []).append((term, rank))
    kind = texts.schema[key].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [apart(term_hits(t or "", by_first)) for t in batch.column(1).to_pylist()]
            owner = pa.array([i for i, hits in enumerate(found) for _ in hits], pa.int32())
            flat = [h for hits in found for h in hits]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), *[pa.array([h[c] for h in flat], pa.int32()) for c in range(3)]], names=[key, "start", "end", "rank"])

    return texts.select(key, text).mapInArrow(find, f"`{key}` {kind}, start int, end int, rank int")


def older_roles(ranked: DataFrame, year: int, from_rank: int = 4, years: int = 15) -> DataFrame:
    """Roles past the newest ``from_rank`` that ended ``years`` or more years before ``year``. ``ranked``: recency, to_ix."""
    return ranked.where((F.col("recency") >= from_rank) & (F.floor(F.col("to_ix") / 12) <= year - years))
