"""Which metadata values the rows of each bucket have: estimates of how many rows a filter leaves, and buckets it rules out."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_tokens
from ..plans.filters import Group, Leaf, Variant, column, parse


def value_hash(field: Column, value: Column) -> Column:
    """SHA-256 of a field and a value as JSON, told apart from tokens by the byte between."""
    return F.sha2(F.concat(field.cast("binary"), F.unhex(F.lit("00")), value.cast("binary")), 256)


def token_hash(field: Column, token: Column) -> Column:
    return F.sha2(F.concat(field.cast("binary"), F.unhex(F.lit("FF")), token.cast("binary")), 256)


def safe(e: Leaf | Group) -> bool:
    """Whether the estimate is never below the truth: not under a complement."""
    return isinstance(e, Leaf) or e.op != "not" and all(map(safe, e.children))


@dataclass
class FilterIndex:
    """values: field, value (JSON), hash, bucket, n; tokens: field, token, hash, bucket, n: rows of a bucket that have it."""

    values: DataFrame
    tokens: DataFrame
    sizes: dict[int, int]

    @staticmethod
    def build(rows: DataFrame) -> FilterIndex:
        """rows: bucket, metadata (VARIANT). Counts combine within tasks, so a value that all rows have isn't gathered first."""
        each = rows.select("bucket", F.explode(F.try_variant_get("metadata", "$", "map<string,variant>")).alias("field", "v"))
        values = each.groupBy("field", F.to_json("v").alias("value"), "bucket").agg(F.count(F.lit(1)).alias("n"))
        values = values.select("field", "value", value_hash(F.col("field"), F.col("value")).alias("hash"), "bucket", "n")
        text = F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string"))
        words = each.select("bucket", "field", F.explode(F.array_distinct(ascii_tokens(text))).alias("token"))
        tokens = words.groupBy("field", "token", "bucket").agg(F.count(F.lit(1)).alias("n"))
        tokens = tokens.select("field", "token", token_hash(F.col("field"), F.col("token")).alias("hash"), "bucket", "n")
        return FilterIndex(values, tokens, {r.bucket: r["count"] for r in rows.groupBy("bucket").count().collect()})

    def save(self, path: str) -> None:
        """In the order of fields and values, so that a filter reads the row groups of its fields only."""
        self.values.repartitionByRange("field", "value").sortWithinPartitions("field", "value").write.mode("overwrite").parquet(f"{path}/values")
        self.tokens.repartitionByRange("field", "token").sortWithinPartitions("field", "token").write.mode("overwrite").parquet(f"{path}/tokens")

    @staticmethod
    def load(spark: SparkSession, path: str, sizes: dict[int, int]) -> FilterIndex:
        return FilterIndex(spark.read.parquet(f"{path}/values"), spark.read.parquet(f"{path}/tokens"), sizes)

    def matches(self, tree: Any) -> dict[int, int]:
        """About how many rows of each bucket pass: for And the least of its parts, for Or their sum, for Not what is left.

        A comparison is evaluated on the values that there are (ranges, patterns
        and lists alike), each counted as often as rows have it.
        """
        return self._of(parse(tree))

    def _of(self, e: Leaf | Group) -> dict[int, int]:
        if isinstance(e, Leaf):
            name = F.expr("substring(to_json(array(field)), 2, length(to_json(array(field))) - 2)")
            own = self.values.filter(F.col("field") == e.field)
            one = own.withColumn("m", F.parse_json(F.concat(F.lit("{"), name, F.lit(":"), "value", F.lit("}"))))
            got = one.filter(column(e, Variant(F.col("m")))).groupBy("bucket").agg(F.sum("n").alias("n"))
            return {r.bucket: r.n for r in got.collect()}  # a row for each bucket
        parts = [self._of(c) for c in e.children]
        if e.op == "and":
            return {b: n for b in parts[0] if (n := min(p.get(b, 0) for p in parts))}
        if e.op == "or":
            return {b: min(self.sizes.get(b, 0), sum(p.get(b, 0) for p in parts)) for p in parts for b in p}
        return {b: n - parts[0].get(b, 0) for b, n in self.sizes.items() if n > parts[0].get(b, 0)}
