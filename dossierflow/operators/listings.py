"""Listing feeds: flatten, merge, rank, carry forward, contact resolution."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossierflow.functions import contacts as ct
from dossierflow.functions import text as tx
from dossierflow.functions import urls as ux
from dossierflow.operators.lexicon import grams
from dossierflow.operators.scale import bucketed_rank, join_small, keep_first, top_k

STALE_YEAR = r"(?:^|[^0-9])20(?:1[0-9]|2[0-4])(?:$|[^0-9])"


def flatten_feed(feed: DataFrame) -> DataFrame:
    """``sources`` (array of {id, ok, jobs}) to one row per listing with an http link that is not a search page."""
    src = feed.select(F.inline("sources"))
    jobs = src.where(F.coalesce("ok", F.lit(True)) | (F.size("jobs") > 0)).select(
        F.col("id").alias("source"), F.posexplode("jobs").alias("pos", "job"))
    return (jobs.select("source", "pos", "job.*")
            .where((F.coalesce("kind", F.lit("")) != "search") & F.col("url").rlike(r"(?i)^https?://")))


def listing_key(ref: str, url: str) -> Column:
    """The reference code when present, else the canonical address."""
    return F.coalesce(F.nullif(F.concat(F.lit("ref:"), F.lower(ref)), F.lit("ref:")), ux.rank_key(url))


def priority_merge(inputs: list[DataFrame], key: str, order: str) -> DataFrame:
    """Union in priority order; the first row per key wins."""
    parts = [df.withColumn("priority", F.lit(i)) for i, df in enumerate(inputs)]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return keep_first(merged, [key], [F.col("priority"), F.col(order)])


def round_robin(df: DataFrame, source: str, newest_first: Column, bucket: Column, pos: str) -> DataFrame:
    """``turn``: place of a row inside its source, newest first; ``source_order``: first position of the source.
    Reading by (turn, source_order) interleaves the sources. Ranks are built per (source, bucket)."""
    first = df.groupBy(source).agg(F.min(pos).alias("source_order"))
    ranked = bucketed_rank(df, [source], bucket, [newest_first, F.col(pos)], "turn")
    return join_small(ranked, first, source)


def carried_days(snapshots: DataFrame, runs: DataFrame, source: str, day: str, max_days: int = 7, skipped: DataFrame | None = None) -> DataFrame:
    """``source, day, stale_since``: the runs in which a source had no good snapshot, with the day of the last one at most ``max_days`` back.

    ``snapshots``: the (source, day) of good snapshots, distinct; ``runs``: the days a collection ran; ``skipped``: (source, day) that were not
    asked, which are never carried. Each good snapshot reaches to the next one of its source and no further than ``max_days``, so
    rows come from the snapshots and not from a grid of sources and days. A source has at most a row a day here."""
    following = F.lead(day).over(W.partitionBy(source).orderBy(day))
    reach = F.least(F.date_add(day, max_days), F.date_sub(following, 1))
    first = F.date_add(day, 1)
    days = F.when(reach >= first, F.sequence(first, reach))
    gaps = snapshots.select(source, F.col(day).alias("stale_since"), days.alias("_days")).select(source, "stale_since", F.explode("_days").alias(day))
    gaps = gaps.join(runs.select(day).distinct(), day, "left_semi")
    return gaps if skipped is None else gaps.join(skipped.select(source, day), [source, day], "left_anti")


def carry_rows(rows: DataFrame, runs: DataFrame, source: str, day: str, max_days: int = 7, skipped: DataFrame | None = None) -> DataFrame:
    """The listings of every run: a source's own of that day, or where it has none those of the last good day at most ``max_days`` back, flagged
    ``stale`` with the day they come from."""
    gaps = carried_days(rows.select(source, day).distinct(), runs, source, day, max_days, skipped)
    old = rows.join(gaps.withColumnRenamed(day, "_shown").withColumnRenamed("stale_since", day), [source, day])
    old = old.withColumn("stale_since", F.col(day)).withColumn(day, F.col("_shown")).drop("_shown").withColumn("stale", F.lit(True))
    fresh = rows.withColumn("stale_since", F.lit(None).cast(rows.schema[day].dataType)).withColumn("stale", F.lit(False))
    return fresh.unionByName(old)


def source_health(log: DataFrame, results: DataFrame) -> DataFrame:
    """Status per source from what was found, what matched and whether it failed.

    ``log``: source, n_found, failed (one row per attempt); ``results``: source (one row per kept listing)."""
    found = log.groupBy("source").agg(F.sum("n_found").cast("long").alias("n_found"), F.bool_or("failed").alias("failed"))
    matched = results.groupBy("source").agg(F.count(F.lit(1)).alias("n_matched"))
    both = found.join(matched, "source", "full_outer")
    n = F.coalesce("n_matched", F.lit(0))
    return both.select("source", F.coalesce("n_found", F.lit(0)).alias("n_found"), n.alias("n_matched"),
                       F.when(n > 0, "ok").when(F.coalesce("failed", F.lit(False)), "error").otherwise("empty").alias("status"))


def profile_hits(listings: DataFrame, key: str, title: str, text: str, terms: DataFrame, max_words: int = 1) -> DataFrame:
    """Role, step and skill terms of a profile found in each listing (roles and steps in the title only).

    ``terms``: kind (role/step/skill), term (lower-case tokens, up to ``max_words`` of them with one blank between)."""
    runs = lambda c: tx.words(c) if max_words == 1 else F.transform(grams(c, max_words), lambda g: g["form"])
    in_title = F.array_distinct(runs(title))
    rest = F.array_except(runs(text), in_title)
    tokens = listings.select(key, F.explode(F.concat(
        F.transform(in_title, lambda w: F.struct(w.alias("term"), F.lit(True).alias("head"))),
        F.transform(rest, lambda w: F.struct(w.alias("term"), F.lit(False).alias("head"))))).alias("_t"))
    hits = join_small(tokens.select(key, "_t.term", "_t.head"), terms, "term")
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("int")
    return hits.groupBy(key).agg(n((F.col("kind") == "role") & F.col("head")).alias("role_hits"),
                                 n((F.col("kind") == "step") & F.col("head")).alias("step_hits"),
                                 n(F.col("kind") == "skill").alias("skill_hits"))


def rank_listings(listings: DataFrame, hits: DataFrame, key: str, exact: Column, region: Column, limit: int = 45, strict: bool = False) -> DataFrame:
    """68 + 14 per role hit + 4 per skill + 10 exact place or 6 region - 3 for a step-up, at most 99; best first.
    A listing needs a role hit, a step hit or two skills; in strict mode only a role or step hit in its title will do."""
    j = hits.where("role_hits > 0 OR step_hits > 0" + ("" if strict else " OR skill_hits >= 2")).join(listings, key)
    step = (F.col("role_hits") == 0) & (F.col("step_hits") > 0)
    roles = F.when(F.col("role_hits") > 0, F.col("role_hits")).otherwise(F.col("step_hits"))
    score = F.least(F.lit(99), 68 + 14 * roles + 4 * F.col("skill_hits")
                    + F.when(exact, 10).when(region, 6).otherwise(0) - F.when(step, 3).otherwise(0)).cast("int")
    return (j.withColumn("score", score).withColumn("track", F.when(step, "step").otherwise("level"))
            .orderBy(F.col("score").desc(), F.col("title"), F.col(key)).limit(limit))


def score_web_hits(hits: DataFrame, role: Column, skills: list[str], place: str, board_host: str) -> DataFrame:
    """45 + 32 role + 4 per skill + 10 place + 8 board host - 12 stale year in the title, clamped to 40..99.

    Reads ``title``, ``content``, ``url``; ``why`` keeps at most six distinct reasons."""
    hay = F.lower(F.concat_ws(" ", "title", "content"))
    found = [F.contains(hay, F.lit(s)) for s in skills]
    raw = (F.lit(45) + F.when(role.isNotNull(), 32).otherwise(0)
           + sum((4 * f.cast("int") for f in found), F.lit(0))
           + F.when(F.lit(place != "") & F.contains(hay, F.lit(place)), 10).otherwise(0)
           + F.when(F.col("url").rlike(board_host), 8).otherwise(0)
           - F.when(F.col("title").rlike(STALE_YEAR), 12).otherwise(0))
    why = F.array_compact(F.array(role, *[F.when(f, F.lit(s)) for f, s in zip(found, skills)],
                                  F.when(F.contains(hay, F.lit(place)), F.lit(place))))
    return (hits.withColumn("score", F.least(F.lit(99), F.greatest(F.lit(40), raw)).cast("int"))
            .withColumn("why", F.array_distinct(why)))


def per_source_cap(df: DataFrame, source: str, order: list[Column], n: int) -> DataFrame:
    return top_k(df, [source], order, n)


def rank_emails(df: DataFrame, keys: list[str], text: str, host: Column, junk_host: str = ct.JUNK_HOST) -> DataFrame:
    """Usable addresses per key with their best score, best first by ``rk``."""
    rows = df.select(*keys, host.alias("_host"), F.explode(F.filter(
        ct.emails(text), lambda e: ct.is_usable_email(e, junk_host))).alias("email"))
    best = rows.groupBy(*keys, "email").agg(F.max(ct.email_score(F.col("email"), F.col("_host"))).alias("score"))
    w = W.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("email"))
    return best.withColumn("rk", F.row_number().over(w))


def resolve_contact(listings: DataFrame, key: str, text: str, desks: DataFrame, junk_host: str = ct.JUNK_HOST,
                    fabricated: str = r"(?!)") -> DataFrame:
    """Address by provenance: printed in the text, stored and neither guessed nor fabricated, a known desk, none.

    ``listings``: key, text, source, to_address, via; ``desks``: source, desk_email, desk_via."""
    printed = keep_first(rank_emails(listings, [key], text, F.lit(""), junk_host), [key],
                         [F.col("rk")]).select(key, F.col("email").alias("printed"))
    stored = F.when(F.col("to_address").rlike(rf"^{ct.EMAIL}$") & ~F.col("via").rlike(r"(?i)^(?:Corporate HR Mailbox|Employer Domain HR)")
                    & ~F.col("to_address").rlike(fabricated), F.lower("to_address"))
    j = join_small(listings.drop(text).join(printed, key, "left"), desks, "source", "left")
    return j.select(key, F.coalesce("printed", stored, "desk_email", F.lit("")).alias("email"),
                    F.when(F.col("printed").isNotNull(), "Extracted Directly from Job Description")
                    .when(stored.isNotNull(), F.coalesce(F.nullif("via", F.lit("")), F.lit("Verified Listing Email")))
                    .when(F.col("desk_email").isNotNull(), F.col("desk_via"))
                    .otherwise("Apply via Employer Portal / ATS").alias("via"))


def visible_with_reserve(df: DataFrame, group: str, approved: Column, order: Column, cap: int = 6) -> DataFrame:
    """Approved rows always; others fill up to ``cap`` rows per group in order."""
    marked = df.withColumn("_on", approved)
    held = marked.groupBy(group).agg(F.sum(F.col("_on").cast("int")).cast("int").alias("_held"))
    free = top_k(marked.where(~F.col("_on")), [group], [order], cap, "_rk")
    fill = join_small(free, held, group).where(F.col("_rk") <= F.greatest(F.lit(0), cap - F.col("_held")))
    return marked.where(F.col("_on")).drop("_on").unionByName(fill.drop("_on", "_held", "_rk"))


def hydrate_top(ranked: DataFrame, details: DataFrame, key: str, short: Column, order: list[Column], k: int = 5) -> DataFrame:
    """Only the first k short rows fetch their detail: the limit comes before the join."""
    return F.broadcast(ranked.where(short).orderBy(*order).limit(k)).join(details, key)


def funnel_counts(rows: DataFrame, source: str, key: str, ranked: Column, level: Column) -> DataFrame:
    """Per source: rows, different keys, ranked rows and their two tracks. Counted per (source, key) first, so a hot source spreads."""
    n = lambda c: F.sum(c.cast("int")).cast("long")
    part = rows.groupBy(source, key).agg(F.count(F.lit(1)).alias("raw"), n(ranked).alias("ranked"), n(ranked & level).alias("level_track"))
    return part.groupBy(source).agg(F.sum("raw").alias("raw"), F.count(F.lit(1)).alias("uniq"), F.sum("ranked").alias("ranked"),
                                    F.sum("level_track").alias("level_track"), F.sum(F.col("ranked") - F.col("level_track")).alias("step_track"))
