"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, release


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = F.least(F.col("u"), F.min("v").over(Window.partitionBy("u")))
    return both.withColumn("m", least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = F.min("v").over(Window.partitionBy("u"))
    down = down.withColumn("m", least)
    return (
        down.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        .select("e.u", "e.v")
        .where("u <> v")
        .distinct()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of an edge with the least node of its component, roots left out.

    edges: columns u and v, integers; order and repetition don't matter, loops are ignored. Each round
    is written to the shared folder; the number of rounds is logarithmic in the longest path.
    """
    now = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        was = now
        now = materialise(small_star(large_star(was)), "edges")
        # finished when no round changes an edge: all are stars around the least node
        sums = [d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for d in (was, now)]
        release(was)
        if tuple(sums[0]) == tuple(sums[1]):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
