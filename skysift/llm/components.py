"""Connected components of an edge table, by hooking and contraction.

Every node takes its smallest neighbour if that is smaller, and then twice the
node that its choice has taken; edges are rewritten to what their ends took, and
those whose ends agree go. What is left is a smaller graph with the same
components. Ends meet in few rounds: a star, whatever its size, takes one. All
steps are joins and partial aggregations; only an emptiness test reaches the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _tidy(e: DataFrame) -> DataFrame:
    ends = e.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    return ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node that has an edge (u, v); comp is the smallest
    node of its component. Null ends and loops are left out."""
    cur, labels = stored(_tidy(edges)), None
    while labels is None or not cur.isEmpty():
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        take = stored(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")))
        again = take.select(F.col("u").alias("p"), F.col("p").alias("q"))
        for _ in range(2):
            take = take.join(again, "p").select("u", F.col("q").alias("p"))
        take = stored(take)
        named = take.select(F.col("u").alias("comp"), "p")
        labels = take.select(F.col("u").alias("node"), F.col("p").alias("comp")) if labels is None else stored(
            labels.join(named, "comp", "left").select("node", F.coalesce("p", "comp").alias("comp"))
        )
        ends = cur.join(take, "u").select(F.col("p").alias("x"), F.col("v").alias("u")).join(take, "u").select(F.col("x").alias("u"), F.col("p").alias("v"))
        cur = stored(_tidy(ends))
    return labels


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels (node, comp) of components after more edges (u, v): only edges
    between different components are worked on."""
    ends = edges
    for c in ("u", "v"):
        own = labels.select(F.col("node").alias(c), F.col("comp").alias("_c"))
        ends = ends.join(own, c, "left").withColumn(c, F.coalesce("_c", c)).drop("_c")
    ends = stored(_tidy(ends))
    if ends.isEmpty():
        return labels
    more = components(ends)
    named = more.select(F.col("node").alias("comp"), F.col("comp").alias("_p"))
    old = labels.join(named, "comp", "left").select("node", F.coalesce("_p", "comp").alias("comp"))
    return stored(old.unionByName(more.join(labels, "node", "left_anti")))
