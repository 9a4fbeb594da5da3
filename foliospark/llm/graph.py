"""Connected components of an edge table by minimum neighbours and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edge table (a, b): the smallest node it is connected with.

    Each round keeps for every node the edge to its smallest neighbour below, hands its other neighbours below to that
    one, and shortens the chains by one jump.  Edges are grouped by their larger end only, so a hub with many larger
    neighbours is never gathered in one task.  Rounds grow with the logarithm of the longest chain.  Every round is
    written to the shared folder.  Null ends and loops are ignored; no edges give no rows.
    """
    a, b = F.col("a"), F.col("b")
    edges = edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = durable(edges, "edges")
    while True:
        least = durable(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        others = edges.join(least, "u").filter(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        jump = least.join(least.select(F.col("u").alias("m"), F.col("m").alias("mm")), "m", "left")
        jumped = jump.select("u", F.coalesce("mm", "m").alias("v"), F.col("mm").isNotNull().alias("moved"))
        edges = others.withColumn("moved", F.lit(True)).unionByName(jumped).groupBy("u", "v").agg(F.max("moved").alias("moved"))
        edges = durable(edges, "edges")
        if edges.filter("moved").isEmpty():
            break
        edges = edges.drop("moved")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
