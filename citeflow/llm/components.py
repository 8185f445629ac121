"""Connected components of a link table by alternating large and small stars.

Every round is two aggregations with a join each, written to the shared folder (the round before is then deleted); hot
centres are split by adaptive skew joins and minimums combine before the shuffle. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeflow.llm.common import drop_stage, write_stage


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    j = e.join(least, "u")
    down = j.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(e: DataFrame) -> bool:
    """All links are stars: every node points to one other, and nothing that is pointed to points on."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("points"), F.lit(0).alias("aim")).unionByName(
        e.select(F.col("v").alias("x"), F.lit(0).alias("points"), F.lit(1).alias("aim")))
    per = ends.groupBy("x").agg(F.sum("points").alias("points"), F.max("aim").alias("aim"))
    return per.where("points > 1 or points > 0 and aim > 0").isEmpty()


def connected_components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``links`` (u, v: long) -> one row per linked node: node, root (the least node it can reach).

    Loops and repeated links are allowed; nulls are not links. An empty table gives an empty table. Raises if
    ``max_rounds`` rounds do not settle it (rounds grow with the logarithm of the longest chain).
    """
    spark = links.sparkSession
    e = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, path = write_stage(e, "links")
    for _ in range(max_rounds):
        if _settled(e):
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        e, new = write_stage(_small_star(_large_star(e)), "links")
        drop_stage(spark, path)
        path = new
    raise RuntimeError("connected components did not settle")
