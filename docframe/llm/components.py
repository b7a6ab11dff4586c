"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.common import stage

#: Tasks that the edges of one node are spread over.
SALTS = 16


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges with the m of their u; the centre of a large star is spread over SALTS tasks."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    return salted.join(least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["u", "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return _with_least(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(edges, least).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """u, v for every node u that isn't the least of its component, v being the least.

    edges: u, v longs; null ends and loops are ignored, repeated edges count once, no edges give no
    rows.  Each round is two partial minima and joins; rounds grow with the logarithm of a component's
    size.  Only a count and a sum of hashes per round come to the driver.
    """
    now = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == mark or not sign[0]:
            return now
        mark = sign
        now = stage(_small_star(_large_star(now)), "edges")
