"""Keyword report and wording swaps between postings and profiles."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierflow.functions import text as tx
from dossierflow.operators.scale import join_small

RAW_WORDS = r"[^\p{L}\p{N}]+"


def propose_swaps(must: DataFrame, profile_lines: DataFrame, groups: DataFrame, doc: str, profile: str) -> DataFrame:
    """First line of the profile that prints a same-meaning form of a must-have it does not print itself.

    ``must``: doc, profile, concept; ``profile_lines``: profile, line_ix, line; ``groups``: concept, g (forms of one
    meaning share ``g``). The printed form's capital passes to the new word; a preceding a/an that would no longer
    agree drops the proposal. The profile's first printed form per group is found once for words that start with a
    vowel and once for the others, so no pair of forms is ever made."""
    raw = F.filter(F.split("line", RAW_WORDS), lambda w: w != "")
    pairs = F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), raw).alias("prev"), raw.alias("word"))
    tok = (profile_lines.select(profile, "line_ix", "line", F.posexplode(pairs).alias("pos", "_p")).where("_p.word IS NOT NULL")
           .select(profile, "line_ix", F.col("line").alias("before"), "pos", F.col("_p.word").alias("synonym"),
                   F.lower("_p.word").alias("concept"), F.coalesce(F.lower("_p.prev"), F.lit("")).alias("_prev")))
    shown = tok.select(profile, "concept").distinct()
    needed = join_small(must.select(doc, profile, "concept").join(shown, [profile, "concept"], "left_anti"), groups, "concept")
    form = F.struct("line_ix", "pos", "synonym", "before")
    first = join_small(tok, groups, "concept").groupBy(profile, "g").agg(
        F.min(F.when(F.col("_prev") != "a", form)).alias("_vowel"), F.min(F.when(F.col("_prev") != "an", form)).alias("_other"))
    f = F.when(F.col("concept").rlike("^[aeiou]"), F.col("_vowel")).otherwise(F.col("_other"))
    rows = needed.join(first, [profile, "g"]).withColumn("_f", f).where(F.col("_f").isNotNull())
    to = F.when(F.col("_f.synonym").rlike(r"^\p{Lu}"), F.initcap("concept")).otherwise(F.col("concept"))
    key = F.concat_ws("|", "concept", F.col(profile).cast("string"), "_f.before", F.col("_f.pos").cast("string"), "_f.synonym")
    return rows.select(doc, profile, "concept", "_f.line_ix", "_f.pos", "_f.synonym", to.alias("to"), F.md5(key).alias("swap_id"))


def keyword_report(must: DataFrame, profile_tokens: DataFrame, swaps: DataFrame, doc: str, profile: str) -> DataFrame:
    """State per must-have: printed, a swap exists, evidenced by stem, or a gap.

    ``must``: doc, profile, concept, ...; ``profile_tokens``: profile, token, line_ix; ``swaps``: doc, concept."""
    exact = profile_tokens.groupBy(profile, F.col("token").alias("concept")).agg(F.min("line_ix").alias("_exact"))
    stems = profile_tokens.groupBy(profile, tx.stem("token").alias("_s")).agg(F.min("line_ix").alias("_stem"))
    j = (must.join(exact, [profile, "concept"], "left")
         .join(swaps.select(doc, "concept", F.col("line_ix").alias("_swap")), [doc, "concept"], "left")
         .withColumn("_s", tx.stem("concept")).join(stems, [profile, "_s"], "left"))
    state = (F.when(F.col("_exact").isNotNull(), "in-cv").when(F.col("_swap").isNotNull(), "swap")
             .when(F.col("_stem").isNotNull(), "other-words").otherwise("gap"))
    return j.withColumn("state", state).withColumn("evidence_ix", F.coalesce("_exact", "_swap", "_stem")).drop("_exact", "_swap", "_stem", "_s")


def apply_swaps(lines: DataFrame, swaps: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Apply every swap whose ``before`` is exactly the line, right to left, skipping overlaps.

    ``swaps``: keys, at (0-based), synonym, to, before."""
    per = swaps.groupBy(*keys).agg(F.collect_list(F.struct(
        (-F.col("at")).alias("neg_at"), F.col("synonym"), F.col("to"), F.col("before"))).alias("_s"))
    j = lines.join(per, keys, "left")
    ok = F.array_sort(F.filter(F.coalesce("_s", F.array().cast("array<struct<neg_at:int,synonym:string,to:string,before:string>>")),
                               lambda s: (s["before"] == F.col(line)) & (s["synonym"] != "")
                               & (F.substr(F.col(line), 1 - s["neg_at"], F.length(s["synonym"])) == s["synonym"])))
    start = F.struct(F.col(line).alias("t"), F.lit(2_000_000_000).alias("lo"))

    def step(acc, s):
        at = -s["neg_at"]
        free = at + F.length(s["synonym"]) <= acc["lo"]
        swapped = F.concat(F.substr(acc["t"], F.lit(1), at), s["to"], F.substr(acc["t"], at + F.length(s["synonym"]) + 1))
        return F.struct(F.when(free, swapped).otherwise(acc["t"]).alias("t"), F.when(free, at).otherwise(acc["lo"]).alias("lo"))

    return j.withColumn("after", F.aggregate(ok, start, step)["t"]).drop("_s")
