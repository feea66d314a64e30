"""Quality rules (operator 5): robust multivariate outliers by minimum covariance determinant, per language and source.

Each document becomes a vector of transformed statistics. In each group of documents the operator looks for the part of the rows whose
covariance has the least determinant, from a deterministic start (medians and MADs) and by concentration steps: distances of all
rows, the part with the smallest, its mean and covariance. A step is one aggregation over all rows by group and distance bin, in whole
numbers, so that the outcome does not depend on how rows are dealt.
"""
from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossierflow.llm.shared import stored

SYMBOLS = b"#*$%&|<>"
#: Statistics of the vector, and the least standard deviation that each is taken to have in any group: most are constant in clean
#: text, and a slight difference must not count as far away.
FEATURES = {"length": 0.5, "word_length": 0.06, "symbols": 0.06, "capitals": 0.05, "repeated_lines": 0.2, "repeated_words": 0.15, "variety": 0.08}
P = len(FEATURES)
#: Units of a statistic, and the most of them (64 in the statistic itself, far beyond any rejection): products of two then add up in 64
#: bits for 3e10 rows of a group.
UNIT, MOST = 256, 1 << 14
#: Part of a group's rows that the estimate rests on, and steps at most.
KEPT_PART, STEPS = 0.7, 12
#: Rows that a group is lent from its language and a language from the table, so that its scatter goes over from theirs to its own with its
#: number of rows; and rows (two per statistic) that the table is lent from a guess of ``WIDE`` least deviations.
LENT_ROWS, GUESS_ROWS, WIDE = 200, 2 * P, 5
#: Estimates that are broadcast (a few hundred bytes each); more meet the rows in a shuffle join.
BROADCAST_GROUPS = 100_000
#: Chance of a row of the estimated normal distribution to be rejected: less than one clean row of a billion goes.
REJECTED = 1e-9
WINDOW = 8


def repeated_window_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words in windows of ``size`` words that occur twice or more, by ranks of pairs, fours and eights: exact, n log n."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    rank = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    width = 1
    while width < size:
        step = min(width, size - width)
        pair = rank[:-step] * (rank.max() + 1) + rank[step:]
        rank, width = np.unique(pair, return_inverse=True)[1], width + step
    starts = np.flatnonzero(np.bincount(rank)[rank] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return int((np.cumsum(edge) > 0).sum())


def measured(text: bytes) -> tuple[list[int], list[float]]:
    """The contract's counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the transformed vector."""
    words = text.split()
    n = len(words)
    if not n:
        return [0] * 5, [0.0] * P
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else int(np.count_nonzero((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80))
    symbols = sum(map(joined.count, (SYMBOLS[i:i + 1] for i in range(len(SYMBOLS)))))
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = len(lines) - len(set(lines))
    repeats = repeated_window_words(words)
    capitals = len(joined) - len(joined.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    log_n = float(np.log(n))
    vector = [log_n, float(np.log(chars / n)), (symbols / n) ** 0.5, (capitals / chars) ** 0.5, again / len(lines) if again else 0.0,
              repeats / n, float(np.log(len(set(words)))) - log_n]
    return [n, chars, symbols, again, repeats], vector


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``doc_id, digest, lang, source``, the counts, ``base_failed`` and the vector ``x0, x1, ...`` in whole units, of every row."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    names = ["doc_id", "digest", "lang", "source", *counts, *(f"x{i}" for i in range(P))]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measured(t) for t in batch.column(4).to_pylist()]
            own = np.array([c for c, _ in rows], np.int64).reshape(-1, 5)
            units = np.clip(np.rint(np.array([v for _, v in rows]).reshape(-1, P) * UNIT), -MOST, MOST).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), *map(pa.array, own.T.copy()), *map(pa.array, units.T.copy())], names=names)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("digest"), F.col(lang).cast("string").alias("lang"),
                       F.col(source).cast("string").alias("source"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, digest long, lang string, source string, " + ", ".join(f"{c} long" for c in names[4:])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.mapInArrow(measure, schema).withColumn("base_failed", failed)


def grouped(rows: DataFrame) -> DataFrame:
    """Adds ``g``, the row's group by language and source, and the groups above it, ``g1`` of its language and ``g2`` of the table."""
    key = lambda k, *by: F.xxhash64(F.lit(k), *[F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in by])
    return rows.select("*", key(0, "lang", "source").alias("g"), key(1, "lang").alias("g1"), key(2).alias("g2"))


def chi_square(p: int, below: float) -> float:
    """Quantile, by the cube-root normal approximation."""
    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(below) * (2 / (9 * p)) ** 0.5) ** 3


def distance() -> Column:
    """Squared Mahalanobis distance by the group's mean ``m`` and the rows ``w`` of the inverse triangular root of its covariance."""
    away = [F.col(f"x{i}") - F.col("m")[i] for i in range(P)]
    terms, at = [], 0
    for i in range(P):
        row = sum((F.col("w")[at + j] * away[j] for j in range(1, i + 1)), F.col("w")[at] * away[0])
        terms.append(row * row)
        at += i + 1
    return sum(terms[1:], terms[0])


def bin_of(d: Column) -> Column:
    """Distance bins of about one per cent; a few thousand in all."""
    return F.floor(64 * F.log2(1 + F.least(d, F.lit(1e12)))).cast("int")


def with_groups(rows: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with the values of their group. ``groups`` is stored, so counting it is cheap; up to ``BROADCAST_GROUPS`` rows it is broadcast,
    so that a group with a third of all rows stays spread."""
    return rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups, "g", how)


def roots(moments: DataFrame) -> DataFrame:
    """``g, m, w, det``: mean, inverse triangular root and log determinant from ``g, n, s`` (sums) ``, ss`` (sums of products)."""
    floor = np.diag([(UNIT * s) ** 2 for s in FEATURES.values()])
    low = np.tril_indices(P)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, n, s, ss = (batch.column(i).to_pylist() for i in range(4))
            out = []
            for k in range(len(g)):
                mean = np.array(s[k], float) / n[k]
                cov = np.zeros((P, P))
                cov[low] = np.array(ss[k], float) / n[k]
                cov = np.tril(cov) + np.tril(cov, -1).T - np.outer(mean, mean) + floor
                root = np.linalg.cholesky(cov)
                out.append((g[k], mean.tolist(), np.linalg.inv(root)[low].tolist(), 2 * float(np.log(np.diag(root)).sum())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["g", "m", "w", "det"])

    return moments.mapInArrow(solve, "g long, m array<double>, w array<double>, det double")


def estimates(rows: DataFrame, kept_part: float = KEPT_PART, steps: int = STEPS) -> DataFrame:
    """``g, m, w, det, scale``: the estimate of each group of ``rows`` (stored, with ``g`` and the vector). ``scale`` is what
    brings the median squared distance down to that of a chi-square distribution, 1 at least."""
    xs = [f"x{i}" for i in range(P)]
    middle = stored(rows.groupBy("g").agg(*[F.percentile(x, 0.5).alias(x) for x in xs]), "outlier-middle")
    off = with_groups(rows, middle.select("g", *[F.col(x).alias(f"c{x}") for x in xs])).groupBy("g").agg(
        *[F.percentile(F.abs(F.col(x) - F.col(f"c{x}")), 0.5).alias(f"d{x}") for x in xs])
    zero = F.lit(0.0)
    spread = [F.sqrt(F.pow(F.col(f"d{x}") * 1.4826, 2) + (UNIT * s) ** 2) for x, s in zip(xs, FEATURES.values())]
    start = middle.join(off, "g").select("g", F.array(*[F.col(x).cast("double") for x in xs]).alias("m"),
                                         F.array(*[1 / spread[i] if i == j else zero for i in range(P) for j in range(i + 1)]).alias("w"), zero.alias("det"))
    now, done = stored(start, "outlier-start"), False
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)]
    products = [F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"p{i}_{j}") for i in range(P) for j in range(i + 1)]
    added = [c for c in (*(f"s{i}" for i in range(P)), *(f"p{i}_{j}" for i in range(P) for j in range(i + 1)))]
    for _ in range(steps):
        bins = with_groups(rows, now.select("g", "m", "w")).groupBy("g", bin_of(distance()).alias("bin")).agg(F.count(F.lit(1)).alias("n"), *sums, *products)
        order = W.partitionBy("g").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
        inner = (bins.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).withColumn("all", F.sum("n").over(W.partitionBy("g")))
                 .where(F.col("before") < kept_part * F.col("all")))
        moments = inner.groupBy("g").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in added]).select(
            "g", "n", F.array(*added[:P]).alias("s"), F.array(*added[P:]).alias("ss"))
        following = stored(roots(moments), "outlier-step")
        moved = following.join(now.select("g", F.col("det").alias("was")), "g").agg(F.max(F.abs(F.col("det") - F.col("was")))).first()[0]
        now, done = following, moved is None or moved < 1e-9
        if done:
            break
    bins = with_groups(rows, now.select("g", "m", "w")).groupBy("g").agg(F.percentile(bin_of(distance()), 0.5).alias("bin"))
    wide = (F.pow(F.lit(2.0), (F.col("bin") + 1) / 64) - 1) / chi_square(P, 0.5)
    return now.join(bins.select("g", F.greatest(F.lit(1.0), wide).alias("scale")), "g")


def shrunk(groups: DataFrame, known: DataFrame, lent_rows: int) -> DataFrame:
    """``g, m, w``: each group's estimate, drawn towards that of its language as if that lent it ``lent_rows`` rows, the language's towards the
    table's likewise, and the table's towards a wide guess that few rows outweigh. ``groups``: g, g1, g2; ``known``: the estimates of all three levels with their rows ``n``."""
    low = np.tril_indices(P)
    least = np.array([UNIT * s for s in FEATURES.values()])
    levels = ("g2", "g1", "g")
    for k in levels:
        groups = groups.join(known.select(F.col("g").alias(k), F.struct("n", "m", "w", "scale").alias(f"_{k}")), k, "left")

    def covariance(e: dict) -> np.ndarray:
        root = np.zeros((P, P))
        root[low] = e["w"]
        root = np.linalg.inv(root)
        return root @ root.T * e["scale"]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for g, *found in zip(*(c.to_pylist() for c in batch.columns)):
                if found[0] is None:  # no row of the table passed the base rules
                    continue
                mean, cov = np.array(found[0]["m"]), np.diag((WIDE * least) ** 2)
                for lent, e in zip((GUESS_ROWS, lent_rows, lent_rows), found):
                    if e is not None:
                        own, part = np.array(e["m"]), e["n"] / (e["n"] + lent)
                        away = own - mean
                        cov = part * covariance(e) + (1 - part) * cov + part * (1 - part) * np.outer(away, away)
                        mean = part * own + (1 - part) * mean
                out.append((g, mean.tolist(), np.linalg.inv(np.linalg.cholesky(cov))[low].tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["g", "m", "w"])

    return groups.select("g", *[f"_{k}" for k in levels]).mapInArrow(draw, "g long, m array<double>, w array<double>")


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", kept_part: float = KEPT_PART,
            rejected: float = REJECTED, lent_rows: int = LENT_ROWS) -> DataFrame:
    """The counts and verdict of every row: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    distance, digest``.

    Rows that fail the base rules take no part in the estimates. A row is rejected if its squared distance from its group is above the
    chi-square quantile that a row of the group's own distribution passes with chance ``rejected``.

    A null text has no words and fails the base rules, as does an empty one; null languages and sources are values like others. Every group,
    however small, is judged by its own estimate drawn towards that of its language, and that towards the table's; the fewer its rows, the
    more. A group without a row that passed has no distance of its own making, only the lent one. Repeated rows give repeated results, an empty
    table none; texts of any length are measured whole; further columns are left out whatever their names."""
    rows = stored(grouped(statistics(docs, doc_id, text, lang, source)), "statistics")
    passed = rows.where(~F.col("base_failed"))
    fit = passed.select(F.explode(F.array("g", "g1", "g2")).alias("g"), *[f"x{i}" for i in range(P)])
    sizes = fit.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    known = stored(estimates(fit, kept_part).join(sizes, "g"), "outlier-estimates")
    final = stored(shrunk(rows.select("g", "g1", "g2").distinct(), known, lent_rows), "outlier-groups")
    judged = with_groups(rows, final, "left").select(*rows.columns, distance().alias("distance"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & F.coalesce(F.col("distance") <= chi_square(P, 1 - rejected), F.lit(True))).alias("kept"),
                         "distance", "digest")


def kept_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that are rejected; columns as they are whatever their names, repeated rows stay."""
    out = quality(docs, doc_id, text, **options).where(~F.col("kept")).select("doc_id", "digest").distinct()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("own"), F.xxhash64(text).alias("text_hash"))
    return row.join(out, row["own"].eqNullSafe(out["doc_id"]) & (row["text_hash"] == out["digest"]), "left_anti").select("row.*")
