"""A corpus pipeline of five of the operators: run(spark, sf_dir) takes documents through all stages.

Each stage reads what its predecessor has written as Parquet. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm._io import cut, table
from quarrystone.llm.decontaminate import contamination
from quarrystone.llm.mixing import mix
from quarrystone.llm.near_dedup import near_duplicates
from quarrystone.llm.quality_rules import judge
from quarrystone.llm.sharding import shard


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the threshold table.

    A null text has no words and goes; an empty table stays one; repeated rows are judged alike; whole texts count, however long.
    """
    return judge(docs).filter("kept").select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the one with the least doc_id, an id coming before none.

    Where ids repeat or are null, rows are told apart by id, text and number,
    and compared like any others; of equal rows any one stays. A text without
    words has no group and stays; an empty table stays one.
    """
    if docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        return docs.join(near_duplicates(docs).filter("kept").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    key = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("n"))
    keyed = cut(docs.select(key.alias("doc_id"), "text", F.struct(*docs.columns).alias("row")), "pipeline-keyed")
    kept = near_duplicates(keyed.select("doc_id", "text")).filter("kept").select("doc_id")
    return keyed.join(kept, "doc_id", "left_semi").select("row.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any word in a window of the benchmark.

    A passage in a long document counts as much as one in a short document. A
    null text has no words and stays; repeated rows fare alike; an empty
    benchmark removes nothing.
    """
    return contamination(docs, table(spark, sf_dir, "benchmark")).filter("n_hit = 0").select(*docs.columns)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: no, one or two rows.

    A text without words has size 0 and goes; a null source is a source; repeated rows are rows of their own.
    """
    row = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row"))
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    return mix(row, keep=("row",)).select("row", F.explode(F.array_repeat(F.lit(1), times))).select("row.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row of the mix: null texts count as empty ones, equal texts go together, ids may be null or repeat."""
    return shard(spark, docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_to_targets", mixing_to_targets),
    ("sharding", sharding),
]

#: Label propagation starts from hashes that SQL lacks; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
