"""Connected components of an edge table, with joins and aggregations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinworks.plans.stage import drop, stage


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): for each end of an edge (a, b), the smallest id that it reaches.

    Alternates two contractions ("large star", "small star"): each node links its larger neighbours, then
    its smaller ones, to the smallest neighbour it knows. The neighbourhoods are never collected, only
    their minimum, and the edge table is written between rounds, so a lost executor costs one task.
    No edges: an empty table. Loops and repeated edges have no effect.
    """
    e = stage(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    key = _sum(e)
    while True:  # ends: every round but the last lowers some neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), "low")  # staged: a join of two scans, whose hot keys Spark can split
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stage(large, "large")
        drop(low)
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        new = stage(small.filter("u <> v").distinct(), "small")
        drop(e)
        drop(large)
        drop(low)
        e, was, key = new, key, _sum(new)
        if key == was:
            break
    pairs = e.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
    return pairs.unionByName(roots)


def _sum(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
