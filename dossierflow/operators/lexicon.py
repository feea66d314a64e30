"""Lexicon matching: texts to concepts by token and n-gram equi joins."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierflow.functions import text as tx
from dossierflow.operators.scale import join_small, top_k


def grams_of(text, n: int):
    """Array of (pos, form) for every run of exactly ``n`` tokens."""
    def build(w):
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.struct(
            i.alias("pos"), F.array_join(F.slice(w, i + 1, n), " ").alias("form")))
        return F.when(F.size(w) >= n, runs).otherwise(F.array().cast("array<struct<pos:int,form:string>>"))

    return tx.let(tx.words(text), build)


def gram_hashes(text, n: int):
    """Distinct 64-bit hashes of every run of ``n`` tokens: a narrow blocking key, verified on the words afterwards."""
    def build(w):
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(F.slice(w, i + 1, n)))
        return F.when(F.size(w) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))

    return tx.let(tx.words(text), build)


def gram_keys(text, max_words: int):
    """Distinct hashes of (length, run) for every run of one to ``max_words`` tokens."""
    return tx.let(tx.words(text), lambda w: word_gram_keys(w, max_words))


def word_gram_keys(w, max_words: int, if_length=None):
    """``gram_keys`` of an array of tokens; ``if_length(n)`` is a test whether runs of ``n`` tokens are wanted."""
    def runs(n):
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
        made = F.transform(starts, lambda i: F.xxhash64(F.lit(n), F.slice(w, i + 1, n)))
        return made if if_length is None else F.when(if_length(n), made).otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(F.concat(*[runs(n) for n in range(1, max_words + 1)]))


def grams(text, max_words: int):
    """Every run of one to ``max_words`` tokens."""
    parts = [grams_of(text, n) for n in range(1, max_words + 1)]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def concept_occurrences(texts: DataFrame, keys: list[str], text: str, lexicon: DataFrame, max_words: int = 1,
                        stem_lengths: tuple[int, ...] = ()) -> DataFrame:
    """One row per occurrence: ``keys``, ``concept``, ``pos``.

    ``lexicon``: ``concept, form`` and, when ``stem_lengths`` is given, ``is_stem`` (form matches the start of a
    token; every stem length in use must be listed). The token side never shuffles for a broadcast lexicon.
    """
    if max_words == 1:
        spread = texts.select(*keys, F.posexplode(tx.words(text)).alias("pos", "form"))
    else:
        spread = texts.select(*keys, F.explode(grams(text, max_words)).alias("_g")).select(*keys, "_g.pos", "_g.form")
    if not stem_lengths:
        return join_small(spread, lexicon.select("concept", "form"), "form").select(*keys, "concept", "pos")
    exact = join_small(spread, lexicon.where(~F.col("is_stem")).select("concept", "form"), "form")
    one = spread.where(~F.contains("form", F.lit(" ")))
    prefixes = one.select(*keys, "pos", F.explode(F.array_distinct(F.array(*[
        F.when(F.length("form") >= n, F.left("form", F.lit(n))) for n in stem_lengths]))).alias("form"))
    stems = join_small(prefixes, lexicon.where(F.col("is_stem")).select("concept", "form"), "form")
    cols = [*keys, "concept", "pos"]
    return exact.select(*cols).unionByName(stems.select(*cols))


def concept_match(texts: DataFrame, keys: list[str], text: str, lexicon: DataFrame, **kw) -> DataFrame:
    """``keys``, ``concept``, number of hits and first position."""
    return (concept_occurrences(texts, keys, text, lexicon, **kw)
            .groupBy(*keys, "concept")
            .agg(F.count(F.lit(1)).alias("n_hits"), F.min("pos").alias("first_pos")))


def must_have_top(candidates: DataFrame, key: str, k: int = 3) -> DataFrame:
    """Rank a posting's concepts: demanded, frequent, in the title, early, then lexicon order.

    ``candidates``: key, concept, must, n_hits, in_title, first_pos, lex_order."""
    return top_k(candidates, [key], [F.col("must").desc(), F.col("n_hits").desc(), F.col("in_title").desc(),
                                     F.col("first_pos"), F.col("lex_order")], k)


def custom_tags(df: DataFrame, text: str, tagger, column: str = "tags") -> DataFrame:
    """Hook for a caller's own tagger: a vectorised ``Series -> Series`` of string lists, run in Arrow batches."""
    return df.withColumn(column, F.pandas_udf(tagger, "array<string>")(text))
