"""Connected components by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import cut


def _roots(parent: DataFrame) -> DataFrame:
    """a, b with b < a, one row for each a -> the same with b the root of a's tree."""
    while True:
        up = parent.select(F.col("a").alias("b"), F.col("b").alias("r"))
        parent = cut(parent.join(up, "b", "left").select("a", F.coalesce("r", "b").alias("b"), F.col("r").isNotNull().alias("moved")), "parents")
        moved = not parent.filter("moved").isEmpty()
        parent = parent.drop("moved")
        if not moved:
            return parent


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (ids that can be ordered). Returns id, component: the least id that each id can reach, for ids that aren't their own.

    Each round every tree with a smaller neighbour is hooked to its least one,
    trees are flattened, and edges move to the roots; edges within a tree go.
    """
    label = None
    e = cut(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not e.isEmpty():
        roots = _roots(e.groupBy("a").agg(F.min("b").alias("b")))
        up = roots.select(F.col("a").alias("x"), F.col("b").alias("r"))
        if label is None:
            label = roots.select(F.col("a").alias("id"), F.col("b").alias("component"))
        else:
            old = label.join(up, label.component == up.x, "left").select("id", F.coalesce("r", "component").alias("component"))
            label = old.unionByName(roots.join(label, roots.a == label.id, "left_anti").select(F.col("a").alias("id"), F.col("b").alias("component")))
        down = up.select(F.col("x").alias("y"), F.col("r").alias("s"))
        e = e.join(up, e.a == up.x, "left").join(down, e.b == down.y, "left").select(F.coalesce("r", "a").alias("a"), F.coalesce("s", "b").alias("b"))
        e = cut(e.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    return label if label is not None else e.select(F.col("a").alias("id"), F.col("b").alias("component"))
