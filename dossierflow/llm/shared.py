"""What the operators share: the folder for tables between jobs, run totals over many parts, and text columns without nulls."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: White space between words: blank and the controls from tab to carriage return.
WORD_GAP = r"[ \t-\r]+"
#: Parts are added up in blocks of so many, so that no window holds more rows than this or the number of blocks.
BLOCK = 1024


def scratch(spark: SparkSession, name: str) -> str:
    """A new place below the shared folder that the session names in ``spark.checkpoint.dir``.

    Where the session names none and all runs on one machine (tests), a temporary folder becomes that setting; on a cluster that is an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="dossierflow-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: later jobs neither repeat nor lose the work before it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove the files of a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir").rstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getParent().getName() == top.rsplit("/", 1)[-1]:
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def filled(text: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def before_parts(sizes: DataFrame, keys: list[str], part: str, size: str) -> DataFrame:
    """For every (keys, part) the sum of ``size`` over the parts before it, as ``before``.

    ``sizes`` has one row per (keys, part). Sums run inside blocks of parts and over the totals of the blocks, so no task
    holds all parts of a key."""
    rows = sizes.withColumn("_block", F.floor(F.col(part) / BLOCK))
    earlier = lambda by, order: F.coalesce(F.sum(size).over(
        W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    one = keys or [F.lit(0)]
    blocks = (rows.groupBy(*keys, "_block").agg(F.sum(size).alias(size))
              .select(*keys, "_block", earlier(one, "_block").alias("_base")))
    inside = rows.withColumn("_inside", earlier([*keys, "_block"], part))
    return (inside.join(blocks, [*keys, "_block"])
            .select(*keys, part, (F.col("_base") + F.col("_inside")).cast("long").alias("before")))


def file_system(path: str):
    """The file system of a folder and the path in it, for tasks that write or read files of their own format. Any scheme that
    pyarrow knows (file, hdfs, s3, gs, abfs) will do."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)
