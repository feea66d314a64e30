"""Overlays, upserts, profile merges and version diffs."""
from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossierflow.functions import text as tx
from dossierflow.operators.scale import keep_first


def merge_overlay(base: DataFrame, changed: DataFrame, hidden: DataFrame, added: DataFrame, key: str) -> DataFrame:
    """Base minus hidden rows, fields overridden by non-null changed ones, plus added rows."""
    fields = [c for c in base.columns if c != key]
    ch = changed.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    kept = base.join(hidden.select(key).distinct(), key, "left_anti").join(ch, key, "left")
    touched = F.lit(False)
    for f in fields:
        touched = touched | F.col(f"_{f}").isNotNull()
    rows = kept.select(key, *[F.coalesce(F.col(f"_{f}"), F.col(f)).alias(f) for f in fields], F.lit(False).alias("own"), touched.alias("changed"))
    return rows.unionByName(added.select(key, *fields, F.lit(True).alias("own"), F.lit(False).alias("changed")))


def minimal_overlay(base: DataFrame, edited: DataFrame, key: str) -> DataFrame:
    """Only the fields that differ from the base; rows with none are dropped."""
    fields = [c for c in base.columns if c != key]
    j = edited.join(base.select(key, *[F.col(f).alias(f"_{f}") for f in fields]), key)
    out = j.select(key, *[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.col(f)).alias(f) for f in fields])
    return out.where(" OR ".join(f"`{f}` IS NOT NULL" for f in fields))


def same_duty(x: Column, y: Column, min_chars: int = 40) -> Column:
    """The same words, or one wholly inside the other when both are long."""
    return (x == y) | ((F.length(x) >= min_chars) & (F.length(y) >= min_chars) & (F.contains(x, y) | F.contains(y, x)))


def merge_profiles(base: DataFrame, add: DataFrame, key: str, fill: list[str], longest: list[str], skills: str, lines: str,
                   skill_cap: int | None = None, line_cap: int | None = None) -> DataFrame:
    """Two profiles per key: the base wins filled fields, the longer text wins, skills and lines append what is new.

    ``skills`` and ``lines`` are arrays bounded by their documents; counts of what was gained come along. Everything is kept unless
    the caller asks for a cap. Lines are normalised once per side; only pairs of long ones are searched in each other."""
    j = base.join(add.select(key, *[F.col(c).alias(f"_{c}") for c in [*fill, *longest, skills, lines]]), key, "full_outer")
    empty = F.array().cast("array<string>")
    some = lambda c: F.coalesce(F.col(c), empty)
    cols = [F.coalesce(F.nullif(F.trim(f), F.lit("")), F.nullif(F.trim(f"_{f}"), F.lit("")), F.lit("")).alias(f) for f in fill]
    cols += [F.when(F.length(F.coalesce(f"_{f}", F.lit(""))) > F.length(F.coalesce(f, F.lit(""))), F.col(f"_{f}"))
             .otherwise(F.coalesce(f, F.lit(""))).alias(f) for f in longest]
    merged_skills = F.array_distinct(F.concat(some(skills), some(f"_{skills}")))
    merged_skills = merged_skills if skill_cap is None else F.slice(merged_skills, 1, skill_cap)
    normal = lambda c: F.transform(c, lambda x: F.struct(tx.norm(x).alias("k"), x.alias("x")))
    j = j.withColumn("_own", normal(some(lines))).withColumn("_new", normal(some(f"_{lines}")))
    j = j.withColumn("_keys", F.transform("_own", lambda o: o["k"]))
    # equal lines go by a hash set; what is left of the long added lines is searched in all long own ones at once (no line holds a line feed), and
    # only own lines that lie somewhere in the added ones are tried line by line
    long = lambda c: F.filter(c, lambda k: F.length(k) >= 40)
    j = (j.withColumn("_left", F.array_except(F.transform("_new", lambda n: n["k"]), F.array_union("_keys", F.array(F.lit("")))))
         .withColumn("_long", F.array_distinct(long("_keys"))))
    inner = tx.let(F.array_join(long("_left"), "\n"), lambda added: F.filter("_long", lambda o: F.contains(added, o)))
    told = lambda k, own: (F.length(k) >= 40) & (F.contains(own["body"], k) | F.exists(own["inner"], lambda o: F.contains(k, o)))
    own = F.struct(F.array_join("_long", "\n").alias("body"), inner.alias("inner"))  # bound by let: a plain column would be made again for every line
    j = j.withColumn("_left", tx.let(own, lambda o: F.filter("_left", lambda k: ~told(k, o))))
    fresh = tx.let(F.col("_left"), lambda left: F.transform(F.filter("_new", lambda n: F.array_contains(left, n["k"])), lambda n: n["x"]))
    merged_lines = F.concat(some(lines), fresh)
    merged_lines = merged_lines if line_cap is None else F.slice(merged_lines, F.lit(1), F.greatest(F.size(some(lines)), F.lit(line_cap)))
    out = j.select(key, *cols, merged_skills.alias(skills), merged_lines.alias(lines), F.size(some(skills)).alias("_ns"), F.size(some(lines)).alias("_nl"))
    return (out.withColumn("gained_skills", F.greatest(F.lit(0), F.size(skills) - F.col("_ns")))
            .withColumn("gained_lines", F.size(lines) - F.col("_nl")).drop("_ns", "_nl"))


def upsert(target: DataFrame, batch: DataFrame, ident: str, second: str, pos: str) -> DataFrame:
    """Update by id or by the second key, else insert; an update keeps the original id, the last batch row wins."""
    t_key = target.groupBy(second).agg(F.min(ident).alias("_by_key"))
    b_key = batch.groupBy(second).agg(F.min(ident).alias("_by_batch"))
    t_id = target.select(F.col(ident).alias("_own"))
    fits = F.coalesce(F.col(second), F.lit("")) != ""
    res = (batch.join(t_id, batch[ident] == t_id["_own"], "left").join(t_key, second, "left").join(b_key, second, "left")
           .withColumn("_id", F.coalesce("_own", F.when(fits, F.coalesce("_by_key", "_by_batch")), F.col(ident))))
    last = keep_first(res.select("_id", *batch.columns), ["_id"], [-F.col(pos)])
    fresh = last.drop(ident).withColumnRenamed("_id", ident).select(*batch.columns)
    return target.join(fresh.select(ident), ident, "left_anti").select(*target.columns).unionByName(fresh.select(*target.columns))


def diff_versions(new: DataFrame, old: DataFrame, doc: str) -> DataFrame:
    """Rows removed, added, edited (same place, other text) or moved (same text, other parent).

    ``new``/``old``: doc, parent, pos, text; equal texts pair up in order."""
    key = tx.norm("text")
    nth = lambda df: df.withColumn("_k", key).withColumn("_n", F.row_number().over(W.partitionBy(doc, "_k").orderBy("parent", "pos")))
    n, o = nth(new), nth(old)
    j = n.select(doc, "_k", "_n", F.col("parent").alias("np"), F.col("pos").alias("npos")).join(
        o.select(doc, "_k", "_n", F.col("parent").alias("op"), F.col("pos").alias("opos")), [doc, "_k", "_n"], "full_outer")
    moved = j.where("np IS NOT NULL AND op IS NOT NULL AND np <> op").select(doc, F.lit("moved").alias("change"), "np", "npos")
    plus = j.where("op IS NULL").select(doc, F.col("np").alias("p"), F.col("npos").alias("q"), F.lit(True).alias("_new"))
    minus = j.where("np IS NULL").select(doc, F.col("op").alias("p"), F.col("opos").alias("q"), F.lit(True).alias("_old"))
    rest = plus.join(minus, [doc, "p", "q"], "full_outer")
    change = F.when(F.col("_new").isNull(), "removed").when(F.col("_old").isNull(), "added").otherwise("edited")
    return moved.select(doc, "change", F.col("np").alias("parent"), F.col("npos").alias("pos")).unionByName(
        rest.select(doc, change.alias("change"), F.col("p").alias("parent"), F.col("q").alias("pos")))


def document_text(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Ordered sections of a record to one text, however many rows it has. A record's text must fit in a row, as any text does."""
    packed = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.groupBy(key).agg(F.array_join(F.transform(packed, lambda x: x[text]), "\n").alias("body"))


def combine_sources(a: DataFrame, b: DataFrame, key: str, headline: str, parts: str) -> DataFrame:
    """The looser merge of two tellings: the different headlines joined by a bar, and the first one's parts followed by the second
    one's that are new."""
    j = a.select(key, F.col(headline).alias("_ah"), F.col(parts).alias("_ap")).join(b.select(key, F.col(headline).alias("_bh"), F.col(parts).alias("_bp")), key, "full_outer")
    empty = F.array().cast("array<string>")
    first, second = F.coalesce("_ap", empty), F.coalesce("_bp", empty)
    fresh = tx.let(first, lambda own: F.filter(second, lambda s: ~F.array_contains(own, s)))
    return j.select(key, F.array_join(F.array_distinct(F.array_compact(F.array("_ah", "_bh"))), " | ").alias(headline), F.concat(first, fresh).alias(parts))


def orphan_rows(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is gone."""
    return rows.join(parents.select(key).distinct(), key, "left_anti")


def forget_unmatched(items: DataFrame, key: str, unmatched: Column) -> DataFrame:
    """Items without the keys of unmatched ones, so that their messages may match again."""
    return items.join(items.where(unmatched).select(key).distinct(), key, "left_anti")


def values_at(values: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Values of the stored paths that are asked for; both sides keyed by record and path."""
    return values.join(asked.select(*keys).distinct(), keys)


def rising(values: list[int]) -> set[int]:
    """Places of a longest rising run of the values (the one whose ends are smallest), by patience sorting."""
    ends, places, before = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(ends, v)
        before.append(places[k - 1] if k else -1)
        if k == len(ends):
            ends.append(v)
            places.append(i)
        else:
            ends[k], places[k] = v, i
    out, at = set(), places[-1] if places else -1
    while at >= 0:
        out.add(at)
        at = before[at]
    return out


def moved_parents(new: DataFrame, old: DataFrame, doc: str, parent: str, pos: str) -> DataFrame:
    """``doc, parent, moved`` of the parents that both versions have. Of these the longest run that keeps its old order has stayed, whatever
    was added or removed between; the others have moved. One record's parents stand in one row."""
    both = new.select(doc, parent, F.col(pos).alias("_new")).join(old.select(doc, parent, F.col(pos).alias("_old")), [doc, parent])
    rows = both.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("_new", "_old", F.col(parent).alias("p")))).alias("ps")).select(
        doc, F.transform("ps", lambda x: x["p"]).alias("p"), F.transform("ps", lambda x: x["_old"].cast("long")).alias("old"))
    doc_type, parent_type = (both.schema[c].dataType.simpleString() for c in (doc, parent))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = batch.column(2).to_pylist()
            stayed = [rising(o) for o in order]
            owner = pa.array([i for i, o in enumerate(order) for _ in o], pa.int32())
            moved = pa.array([k not in s for o, s in zip(order, stayed) for k in range(len(o))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).flatten(), moved], names=[doc, parent, "moved"])

    return rows.mapInArrow(compare, f"`{doc}` {doc_type}, `{parent}` {parent_type}, moved boolean")
