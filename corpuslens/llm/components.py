"""Connected components of a graph of long ids, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component for each node of edges; component is the smallest node that can be reached.

    Each step is a minimum per node, with partial sums before the shuffle, and a join that adaptive execution can split, so
    a node with very many edges needs no task of its own. Only the number of changed edges reaches the driver.
    """
    e = durable(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = durable(large.filter("u <> v").distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        small = durable(small.filter("u <> v").distinct(), "edges")
        same = small.count() == e.count() and small.join(e, ["u", "v"], "left_anti").isEmpty()
        discard(e)
        discard(large)
        e = small
        if same:
            break
    node = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return node.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
