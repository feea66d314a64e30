"""Line dedup (operator 4): windows of three consecutive lines, in DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierflow.llm.shared import stored

WINDOW = 3
GAP = " \t\n\x0b\f\r"


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_windows(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc, digest, at, h1, h2`` of every window of ``rows`` (``doc, digest, t``). Lines without a word do not count, and a line
    is compared without the white space around it. ``at`` is the window's first line among the lines that count."""
    lines = F.filter(F.transform(split_lines(F.col("t")), lambda x: F.btrim(x, F.lit(GAP))), lambda x: x != "")
    hashed = rows.select("doc", "digest", F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))).alias("h"))
    at = F.sequence(F.lit(0), F.size("h") - window)
    pick = lambda i, f: [F.col("h")[i + k][f] for k in range(window)]
    found = F.transform(at, lambda i: F.struct(i.alias("at"), F.xxhash64(*pick(i, "a")).alias("h1"), F.xxhash64(*pick(i, "b")).alias("h2")))
    return hashed.where(F.size("h") >= window).select("doc", "digest", F.explode(found).alias("w")).select("doc", "digest", "w.*")


def repeated_lines(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc, digest, covered``: for each document with later occurrences the lines (among those that count) that they cover.

    The first occurrence of a window is the least by (doc, digest, at). It is a partial aggregation, so a window that a third of
    the corpus holds arrives as one row per task; the join back is one that adaptive execution splits."""
    windows = stored(line_windows(rows, window), "line-windows")
    place = F.struct("doc", "digest", "at")
    firsts = (windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
              .where(~F.col("first").eqNullSafe(F.col("last"))).select("h1", "h2", "first"))
    later = windows.join(firsts, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    at = F.collect_set("at")
    covered = F.flatten(F.transform(at, lambda p: F.sequence(p, p + (window - 1))))
    return later.groupBy("doc", "digest").agg(F.array_sort(F.array_distinct(covered)).alias("covered"))


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` with the shortened ``text``, and ``n_lines, removed_lines`` (0-based line numbers of the old text).

    A window of three consecutive lines that stood earlier in the corpus, in an earlier document or further up, is a repeat; the lines
    that repeats cover go, overlapping windows merged, and all other lines stay as they are. Order is by id, null ids first, then
    by a hash of the text, then by line.

    A null text stays null with 0 lines; a document of fewer than three lines with a word has no window and stays; rows equal in id
    and text count as one document and get the same result; an empty table gives none. Columns of ``docs`` named
    ``n_lines`` or ``removed_lines`` are replaced."""
    id_col, text_col = F.col(f"row.`{doc_id}`"), F.col(f"row.`{text}`")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = packed.select("row", id_col.alias("doc"), F.xxhash64(text_col).alias("digest"))
    repeats = repeated_lines(rows.select("doc", "digest", text_col.alias("t")), window).select(
        F.col("doc").alias("_doc"), F.col("digest").alias("_digest"), "covered")
    joined = rows.join(repeats, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("digest") == F.col("_digest")), "left")
    lines = joined.select("row", "covered", split_lines(text_col).alias("lines"))
    counting = F.filter(F.transform("lines", lambda x, i: F.when(F.btrim(x, F.lit(GAP)) != "", i)), lambda i: i.isNotNull())
    lines = lines.withColumn("counting", F.when(F.col("covered").isNotNull(), counting))
    lines = lines.withColumn("removed", F.coalesce(F.transform("covered", lambda c: F.col("counting")[c]), F.array().cast("array<int>")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed"))
    shorter = F.when(F.col("covered").isNull(), text_col).otherwise(F.array_join(F.transform(stay, lambda i: F.col("lines")[i]), "\n"))
    return lines.select(F.col("row").withField(f"`{text}`", shorter).alias("row"), F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"), "removed").select(
        *[F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_lines", "removed_lines")],
        F.when(text_col.isNull(), 0).otherwise(F.col("n_lines")).alias("n_lines"), F.col("removed").alias("removed_lines"))
