"""Building blocks that keep joins, ranks and first-row picks safe on hot keys."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join with a side expected to be small, without a hint: adaptive execution broadcasts it when its measured size is below
    the session's threshold, and splits hot keys of the big side when it is not. Nothing runs while the plan is built."""
    return big.join(small, on, how)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], salt_by: Column, salts: int = 32,
                how: str = "inner") -> DataFrame:
    """Equi join for hot keys on both shuffled sides: the big side is spread over ``salts`` slots by a
    stable expression and the other side repeated once per slot."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, keys + ["_salt"], how).drop("_salt")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in the given order. Map-side partial aggregation reduces a hot key to one row
    per task before the shuffle, so no task ever holds the whole group."""
    packed = F.struct(*[F.col(c) for c in df.columns])
    return (df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
            .agg(F.min_by(packed, F.struct(*order)).alias("_r"))
            .select("_r.*"))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rk") -> DataFrame:
    """First k rows per key. The literal bound lets Spark keep at most k rows per key and task
    before the shuffle (window group limit)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def bucketed_rank(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], rank: str = "rk") -> DataFrame:
    """Full rank inside each key without one task per key.

    ``bucket`` must grow with ``order``. Rows are ranked inside (key, bucket); the number of rows in
    earlier buckets comes from the counts per bucket and is added.
    """
    rows = df.withColumn("_b", bucket)
    counts = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn(
        "_before", F.coalesce(F.sum("_n").over(
            W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_b").orderBy(*order)))
    return (local.join(before, keys + ["_b"])
            .withColumn(rank, (F.col("_r") + F.col("_before")).cast("int"))
            .drop("_b", "_r", "_before"))


def worked_out_once(df: DataFrame, key: str, by: str, slots: int = 16) -> DataFrame:
    """The rows of ``df`` behind one exchange that is the same for all who read them, so that Spark runs what is before it once. They are packed
    whole per ``key`` and slot of ``by``: of plain columns every reader would ask for its own, and no two exchanges would be equal."""
    slot = F.pmod(F.xxhash64(by), F.lit(slots)).alias("_slot")
    packed = df.groupBy(key, slot).agg(F.collect_list(F.struct(*df.columns)).alias("_rows"))
    return packed.select(F.explode("_rows").alias("_row")).select("_row.*")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in ``spark.checkpoint.dir``. Where it names none and all runs on
    one machine (tests), a temporary folder becomes that setting; on a cluster that is an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="dossierflow-")
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: what follows neither repeats the work before it nor loses it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
