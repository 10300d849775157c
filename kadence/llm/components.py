"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kadence.sources.staging import stage


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link; a component's number is its smallest node.

    Each round every node takes its smallest neighbour as parent, the resulting trees are flattened, and links
    are renamed to the trees' roots; links within a tree vanish. The number of rounds grows with the logarithm
    of the largest component. All state is in written tables, none on the driver; a node with very many links is
    one partial minimum per task.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    edges = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = stage(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
        parents = stage(parents.select("node", F.least("node", "parent").alias("parent")), "parents")
        while True:
            above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grandparent"))
            flatter = parents.join(above, "parent").select("node", F.col("grandparent").alias("parent"), (F.col("grandparent") != F.col("parent")).alias("moved"))
            flatter = stage(flatter, "parents")
            parents = flatter.drop("moved")
            if flatter.filter("moved").isEmpty():
                break
        labels = stage(
            labels.join(parents, labels["component"] == parents["node"], "left").select(
                labels["node"], F.coalesce(parents["parent"], labels["component"]).alias("component")
            ),
            "labels",
        )
        x = parents.select(F.col("node").alias("a"), F.col("parent").alias("x"))
        y = parents.select(F.col("node").alias("b"), F.col("parent").alias("y"))
        moved = edges.join(x, "a").join(y, "b").filter("x <> y")
        edges = stage(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return labels
