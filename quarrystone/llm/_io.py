"""Reading tables, cutting lineage and gapless numbering for the operators of this folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Rows and bytes of an Arrow batch: texts and sets are long, and a batch is held by the JVM and by Python, for each task.
BATCH = {"maxRecordsPerBatch": 1024, "maxBytesPerBatch": 16 << 20}


def small_batches(spark: SparkSession) -> None:
    """Lower Spark's rows and bytes in an Arrow batch, unless they were set to less."""
    for name, most in BATCH.items():
        name = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(name).rstrip("b"))
        if now > most or now <= 0:
            spark.conf.set(name, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: list[tempfile.TemporaryDirectory] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own where it is unset and all runs in one process, as in tests."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if got:
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.TemporaryDirectory(prefix="quarrystone-"))
    return f"file://{_own[0].name}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder, so that a lost executor costs no recomputation of what led to it."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def settled(df: DataFrame, what: str) -> DataFrame:
    """cut(), and Spark drops the shuffle files of what led to the table."""
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        return cut(df, what)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
        spark.sparkContext._jvm.System.gc()


def forget(*tables: DataFrame) -> None:
    """Remove tables that cut() has written; nothing may read them any more."""
    for df in tables:
        spark, jvm = df.sparkSession, df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_key() -> list[Column]:
    """Two independent 64-bit hashes of the column text (null counts as empty)."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("g1"), F.xxhash64(F.lit("other seed"), text).alias("g2")]


def gapless(df: DataFrame, keys: list[str], order: list[str], out: str, rows: int) -> DataFrame:
    """Number the rows of each key from 0 without gaps, in an order that hashes of `order` fix.

    A key's rows are spread over hash buckets, so no task holds a whole key;
    buckets are counted, their offsets summed, and rows numbered within them.
    df is read twice and should be a table.
    """
    buckets = max(1024, rows // 20_000)
    df = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    own = [*keys, "_b"]
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*own).agg(F.count(F.lit(1)).alias("_n")).select(*own, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy(*own).orderBy(*order)) - 1
    return df.withColumn("_i", within).join(offsets, own).withColumn(out, (F.col("_offset") + F.col("_i")).cast("long")).drop("_b", "_i", "_offset")
