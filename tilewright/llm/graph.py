"""Connected components as iterated joins (large star, small star), cut by written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import staged

#: A hub's edges are dealt to so many tasks.
SALTS = 8


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) joined to least (u, m); hubs are salted by their neighbours."""
    left = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    right = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, ["u", "salt"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_least(both.where("v > u"), least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(down, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each edge node's component; nodes without edges to others are absent.

    Self-loops and repeated edges are allowed, edges with a null end are ignored. Raises if it does not settle.
    """
    now = staged(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        now = staged(_small_star(_large_star(now)), "edges")
        sign = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sign == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = sign
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
