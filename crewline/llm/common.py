"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crewline.sources.sinks import materialize

__all__ = ["ascii_lower", "components", "finite_vector", "materialize", "read_table", "words"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Words between blanks and the control characters 09 to 0D; an empty list for null."""
    parts = F.split(F.coalesce(text, F.lit("")), "[ \\x09-\\x0D]+")
    return F.filter(parts, lambda w: w != "")


def finite_vector(vector: Column) -> Column:
    """True for a vector that is not null and holds finite numbers only."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` of every end of an edge; the component is its smallest id.

    Rounds of hooking and contraction: every node that has a smaller neighbour takes the smallest as its
    parent, the forest is flattened by pointer jumping, and the edges move up to the roots. Edges within a
    tree vanish, so a round at least halves the nodes that still have edges. Only minima are aggregated, so
    a node with very many edges combines before the shuffle. Each step is written to the shared folder.
    Nulls and loops are ignored.
    """
    big, small = F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    left = materialize(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(big, small).distinct())
    known = None
    while left.take(1):
        tree = materialize(left.groupBy("hi").agg(F.min("lo").alias("up")))
        while True:
            above = tree.select(F.col("hi").alias("up"), F.col("up").alias("top"))
            jumped = materialize(tree.join(above, "up", "left").select("hi", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
            tree = jumped.drop("moved")
            if not jumped.where("moved").take(1):
                break
        lifted = left
        for end in ("hi", "lo"):
            step = tree.select(F.col("hi").alias(end), F.col("up").alias("top"))
            lifted = lifted.join(step, end, "left").withColumn(end, F.coalesce("top", end)).drop("top")
        lifted = lifted.where("hi != lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo"))
        left = materialize(lifted.distinct())
        if known is None:
            known = tree.select(F.col("hi").alias("id"), F.col("up").alias("component"))
        else:
            step = tree.select(F.col("hi").alias("component"), F.col("up").alias("top"))
            moved = known.join(step, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
            # A root of an earlier round is not listed by itself until it moves.
            known = moved.unionByName(tree.select(F.col("hi").alias("id"), F.col("up").alias("component")))
        known = materialize(known)
    if known is None:
        return left.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    return known.unionByName(known.select("component").distinct().select(F.col("component").alias("id"), "component"))
