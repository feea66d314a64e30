"""Given tables and the views every family of queries derives from them."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierflow.functions import text as tx

TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


SPREAD_ABOVE, SPREAD_BELOW = 1 << 20, 256 << 20


def spread_small(df: DataFrame) -> DataFrame:
    """Give a small table read from a few files one partition per core.

    A table of one row group would put all text work on one task. Tables of 256 MB or more have enough files and
    row groups of their own and are read as they are, without a shuffle."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cores = df.sparkSession.sparkContext.defaultParallelism
    if SPREAD_ABOVE <= size < SPREAD_BELOW and len(df.inputFiles()) < cores:
        return df.repartition(cores)
    return df


class Tables:
    """Lazy access to one directory of parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise AttributeError(name)
        return spread_small(self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))

    @cached_property
    def lexicon(self) -> DataFrame:
        """``bench_lex``: distinct lower-case benchmark words of four or more characters."""
        return (self.benchmark
                .select(F.explode(tx.words("text")).alias("concept"))
                .where(F.length("concept") >= 4)
                .distinct())

    @cached_property
    def paragraphs(self) -> DataFrame:
        """Trimmed non-empty lines of every document with their 0-based position."""
        return (self.documents
                .select("doc_id", "lang", "source", F.posexplode(tx.lines("text")).alias("line_ix", "line")))

    @cached_property
    def sentences(self) -> DataFrame:
        return (self.documents
                .select("doc_id", "lang", "source", F.posexplode(tx.sentences("text")).alias("sent_ix", "sentence")))

    @cached_property
    def order_roles(self) -> DataFrame:
        """One role per order: months [from_ix, to_ix], key the customer."""
        lines = self.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("int").alias("n_lines"))
        return (self.orders
                .join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
                .select("o_custkey", "o_orderkey", "o_orderstatus",
                        (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("from_ix"),
                        (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1 + F.col("n_lines")).alias("to_ix"),
                        "n_lines"))


# The same views as check SQL (common table expressions).
Q_LEXICON = r"""bench_lex AS (
  SELECT DISTINCT concept FROM (
    SELECT unnest(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')) AS concept FROM benchmark)
  WHERE length(concept) >= 4)"""

Q_PARAGRAPHS = r"""paragraphs AS (
  SELECT doc_id, lang, source, (ix - 1)::INT AS line_ix, line FROM (
    SELECT doc_id, lang, source, list_filter(list_transform(string_split(text, chr(10)),
             lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM documents) d,
    unnest(d.ls) WITH ORDINALITY AS u(line, ix))"""

Q_ORDER_ROLES = r"""order_roles AS (
  SELECT o_custkey, o_orderkey, o_orderstatus, (year(o_orderdate) * 12 + month(o_orderdate) - 1)::INT AS from_ix,
         (year(o_orderdate) * 12 + month(o_orderdate) - 1 + n_lines)::INT AS to_ix, n_lines::INT AS n_lines
  FROM orders JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey)"""
