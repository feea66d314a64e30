"""Roles of two sources: which are the same job, one to one, and one list out of both.

Equal roles of an owner (same employer, year and title) are one class with a count, and classes meet, not roles: however often a source repeats
a role, a pair of names is one row. Names meet by containment through four-letter keys: the shorter name's first four letters against all of
the longer one's.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossierflow.functions import text as tx
from dossierflow.operators.merge import same_duty
from dossierflow.operators.scale import bucketed_rank, saved

# Words of a firm's legal form.
LEGAL_WORDS = ("ag", "bv", "co kg", "corp", "corporation", "fz llc", "fzco", "fze", "fzllc", "gmbh", "group", "holding", "holdings", "inc", "kg", "l l c", "limited",
               "llc", "ltd", "nv", "plc", "pte", "pty", "sa", "sarl")
#: Letters of a name that must agree for one to be found inside another.
GRAM = 4
#: Stands for a start year that is not known.
UNKNOWN = 0


def employer_key(c) -> Column:
    """A firm's name without its place (after a long dash) and legal words."""
    alt = "|".join(sorted(LEGAL_WORDS, key=len, reverse=True))
    return tx.squeeze(F.regexp_replace(tx.norm(F.get(F.split(tx.col(c), " — "), F.lit(0))), rf"\b(?:{alt})\b", " "))


def classes(roles: DataFrame, owner: str, ident: str) -> DataFrame:
    """``owner, key, year, title, n, first``: equal roles folded. ``roles``: owner, id, employer, title, year (null where unknown)."""
    return _folded(_keyed(roles, owner, ident), owner, ident)


def _keyed(roles: DataFrame, owner: str, ident: str) -> DataFrame:
    return roles.select(owner, ident, employer_key("employer").alias("key"), F.coalesce("year", F.lit(UNKNOWN)).alias("year"),
                        tx.norm("title").alias("title")).where("key <> ''")


def _folded(keyed: DataFrame, owner: str, ident: str) -> DataFrame:
    return keyed.groupBy(owner, "key", "year", "title").agg(F.count(F.lit(1)).alias("n"), F.min(ident).alias("first"))


def _grams(key: str) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - GRAM + 1, F.lit(1))), lambda i: F.substring(F.col(key), i, F.lit(GRAM))))


def same_names(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs ``key, other`` of names under equal ``keys`` that are the same or of which one, of four letters or more, lies in the other."""
    x, y = a.select(*keys, "key").distinct(), b.select(*keys, F.col("key").alias("other")).distinct()
    equal = x.join(y.withColumn("key", F.col("other")), [*keys, "key"])

    def inside(short: DataFrame, s: str, long: DataFrame, l: str) -> DataFrame:
        needle = short.where(F.length(s) >= GRAM).withColumn("_g", F.substring(F.col(s), 1, GRAM))
        hay = long.where(F.length(l) > GRAM).withColumn("_g", F.explode(_grams(l)))
        return needle.join(hay, [*keys, "_g"]).where((F.length(s) < F.length(l)) & F.contains(F.col(l), F.col(s))).select(*keys, "key", "other")

    return equal.select(*keys, "key", "other").unionByName(inside(x, "key", y, "other")).unionByName(inside(y, "other", x, "key"))


def role_candidates(a: DataFrame, b: DataFrame, owner: str) -> DataFrame:
    """Pairs of classes that may be the same job: same employer and start year; where either year is unknown, same employer and title.
    Columns of ``b`` carry ``b_``."""
    other = b.select(owner, *[F.col(c).alias(f"b_{c}") for c in ("key", "year", "title", "n", "first")])
    dated = same_names(a.where(f"year <> {UNKNOWN}"), b.where(f"year <> {UNKNOWN}"), [owner, "year"])
    by_year = (a.join(dated, [owner, "year", "key"]).withColumnRenamed("other", "b_key").withColumn("b_year", F.col("year"))
               .join(other, [owner, "b_key", "b_year"]))
    titled = same_names(a, b, [owner, "title"])
    by_title = (a.join(titled, [owner, "title", "key"]).withColumnRenamed("other", "b_key").withColumn("b_title", F.col("title"))
                .join(other, [owner, "b_key", "b_title"]).where(f"title <> '' AND {UNKNOWN} IN (year, b_year)"))
    return by_year.unionByName(by_title, allowMissingColumns=True).select(
        owner, "key", "year", "title", "n", "first", "b_key", "b_year", "b_title", "b_n", "b_first")


def match_roles(a: DataFrame, b: DataFrame, owner: str, a_id: str = "a_id", b_id: str = "b_id") -> DataFrame:
    """``a_id, b_id, pass``: each role of ``a`` with at most one of ``b`` and the other way round.

    First (``title``) classes of the same title that may be the same job, in rounds: a class takes the first class of the other side it may be
    (by its first role in stored order) if no earlier class may take that one; of matched classes the n-th role goes with the n-th, and
    what is left over goes on in the next round. Every owner settles at least one pair of classes a round. Then (``only``) a role without a
    partner takes the one role it may be at all, if that is free; the first such role in stored order has it.

    ``a``/``b``: owner, id, employer, title, year. Roles without an employer's name match nothing."""
    ka, kb = (saved(_keyed(side, owner, ident), "role-keys") for side, ident in ((a, a_id), (b, b_id)))  # names are read several times below
    ca, cb = (saved(_folded(side, owner, ident), "role-classes") for side, ident in ((ka, a_id), (kb, b_id)))
    pairs = saved(role_candidates(ca, cb, owner), "role-candidates")
    left = saved(pairs.where("title = b_title AND title <> ''").select("*", F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("b_used")), "role-round")
    mine, theirs = [owner, "key", "year", "title"], [owner, "b_key", "b_year", "b_title"]
    done = None
    while left.limit(1).count():
        best = left.withColumn("_want", F.min(F.struct("b_first", "b_key")).over(W.partitionBy(*mine))).withColumn("_by", F.min(F.struct("first", "key")).over(W.partitionBy(*theirs)))
        settled = saved(best.where((F.col("_want.b_key") == F.col("b_key")) & (F.col("_want.b_first") == F.col("b_first")) & (F.col("_by.key") == F.col("key")) & (F.col("_by.first") == F.col("first")))
                        .withColumn("m", F.least(F.col("n") - F.col("used"), F.col("b_n") - F.col("b_used"))).drop("_want", "_by"), "role-settled")
        done = settled if done is None else done.unionByName(settled)
        spent = settled.select(F.xxhash64(*mine).alias("_a"), F.col("m").alias("_ma"))
        b_spent = settled.select(F.xxhash64(*theirs).alias("_b"), F.col("m").alias("_mb"))
        left = saved(left.withColumn("_a", F.xxhash64(*mine)).withColumn("_b", F.xxhash64(*theirs)).join(spent, "_a", "left").join(b_spent, "_b", "left")
                     .withColumn("used", F.col("used") + F.coalesce("_ma", F.lit(0))).withColumn("b_used", F.col("b_used") + F.coalesce("_mb", F.lit(0)))
                     .where("used < n AND b_used < b_n").select(*left.columns), "role-round")
    numbered = lambda side, ident: saved(bucketed_rank(side, mine, F.floor(F.col(ident) / 65536), [F.col(ident)], "_nth"), "role-numbers")
    ra, rb = numbered(ka, a_id), numbered(kb, b_id)
    named = lambda df: df.withColumnsRenamed({"key": "b_key", "year": "b_year", "title": "b_title"})
    one = ra.join(rb, owner).where("false").select(a_id, b_id)  # no pair at all
    if done is not None:
        steps = done.select(*mine, "b_key", "b_year", "b_title", "used", "b_used", F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("_i"))
        slots = steps.withColumn("_nth", (F.col("used") + F.col("_i")).cast("int")).withColumn("_bn", (F.col("b_used") + F.col("_i")).cast("int"))
        placed = slots.join(ra, [*mine, "_nth"]).select(a_id, owner, "b_key", "b_year", "b_title", F.col("_bn").alias("_nth"))
        one = placed.join(named(rb), [*theirs, "_nth"]).select(a_id, b_id)
    one = saved(one.withColumn("pass", F.lit("title")), "role-matches")
    # a role's candidates, whatever their titles
    totals = pairs.groupBy(*mine).agg(F.sum("b_n").alias("_c"), F.min_by(F.struct("b_key", "b_year", "b_title"), "b_first").alias("_b")).where("_c = 1")
    free = ra.join(one, a_id, "left_anti")
    only = free.join(totals, mine).select(owner, a_id, "_b.*").groupBy(*theirs).agg(F.min(a_id).alias(a_id))
    two = only.join(named(rb), theirs).select(a_id, b_id).join(one, b_id, "left_anti").select(a_id, b_id, F.lit("only").alias("pass"))
    return one.unionByName(two)


def corrected_roles(cv: DataFrame, export: DataFrame, matches: DataFrame, fields: list[str], cv_id: str = "a_id", export_id: str = "b_id") -> DataFrame:
    """``cv`` with the matched role's ``fields`` (title, employer, dates) of the export, and its own lines."""
    given = export.select(export_id, *[F.col(f).alias(f"_{f}") for f in fields])
    found = cv.join(matches.select(cv_id, export_id), cv_id, "left").join(given, export_id, "left")
    return found.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in cv.columns])


def merged_roles(base: DataFrame, add: DataFrame, owner: str, pos: str = "pos") -> DataFrame:
    """One list of roles per owner: ``owner, ix`` (newest first)``, title, employer, dates, end_year, lines, origin, gained``.

    Roles of the same normalised title and employer are one: the base's text, its dates unless empty, its lines and the added ones that say
    something new (not the same words, nor one long line inside the other). Of such roles inside one source the first stands. Roles
    without title and employer are left out. ``base``/``add``: owner, pos, title, employer, dates, end_year, lines."""
    key = F.concat_ws("|", tx.norm(F.coalesce("title", F.lit(""))), tx.norm(F.coalesce("employer", F.lit(""))))

    def side(df: DataFrame, source: int) -> DataFrame:
        return df.select(owner, key.alias("_k"), F.struct(F.lit(source).alias("source"), F.col(pos).cast("long").alias("pos"), "title", "employer", "dates", "end_year",
                                                          "lines").alias("r")).where("trim(replace(_k, '|', '')) <> ''")

    def first(source: int, name: str) -> Column:
        own = F.col("r.source") == source
        return F.min_by(F.when(own, F.col("r")), F.when(own, F.col("r.pos"))).alias(name)

    both = side(base, 0).unionByName(side(add, 1)).groupBy(owner, "_k").agg(first(0, "b"), first(1, "a"))
    empty = F.array().cast("array<string>")
    own, new = F.coalesce("b.lines", empty), F.coalesce("a.lines", empty)
    keyed = lambda xs: F.filter(F.transform(xs, lambda x: F.struct(tx.norm(x).alias("k"), x.alias("x"))), lambda l: l["k"] != "")
    # a line is new if no line kept so far says the same
    kept = lambda: F.aggregate(keyed(new), keyed(own), lambda acc, l: F.when(F.exists(acc, lambda o: same_duty(o["k"], l["k"])), acc).otherwise(F.concat(acc, F.array(l))))
    from_base = F.col("b").isNotNull()
    take = lambda f: F.when(from_base, F.col(f"b.{f}")).otherwise(F.col(f"a.{f}"))
    dates = F.coalesce(F.nullif(F.trim("b.dates"), F.lit("")), F.col("a.dates"), F.lit(""))
    year = F.when(F.trim(F.coalesce("b.dates", F.lit(""))) != "", F.col("b.end_year")).otherwise(F.col("a.end_year"))
    rows = both.select(owner, "_k", take("title").alias("title"), take("employer").alias("employer"), dates.alias("dates"), F.coalesce(year, F.lit(0)).alias("end_year"),
                       F.when(from_base & F.col("a").isNotNull(), F.transform(kept(), lambda l: l["x"])).otherwise(take("lines")).alias("lines"), F.size(keyed(own)).alias("_n"),
                       F.when(from_base & F.col("a").isNotNull(), "both").when(from_base, "base").otherwise("add").alias("origin"),
                       F.when(from_base, 0).otherwise(1).alias("_s"), take("pos").alias("_p"))
    rows = rows.withColumn("gained", F.when(F.col("origin") == "both", F.size("lines") - F.col("_n")).otherwise(0))
    order = [-F.col("end_year"), F.col("_s"), F.col("_p")]
    ranked = bucketed_rank(rows, [owner], -F.col("end_year"), order, "ix")
    return ranked.select(owner, "ix", "title", "employer", "dates", "end_year", "lines", "origin", "gained")
