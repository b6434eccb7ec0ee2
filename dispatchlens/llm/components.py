"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (one node of its component) for each node of ``links`` (a, b).

    A round sends each node to the least node around it and on to where that one
    goes, and then keeps only the links between different places.  Stars are done in
    a round and chains at least halve, so the links left shrink from round to round.
    """
    found = None
    while True:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")))
        on = least.select(F.col("a").alias("to"), F.col("to").alias("beyond"))
        step = stored(least.join(on, "to").select(F.col("a").alias("node"), F.col("beyond").alias("place")))
        if found is None:
            found = step.withColumnRenamed("place", "label")
        else:
            moved = step.withColumnRenamed("node", "label")
            found = found.join(moved, "label", "left").select("node", F.coalesce("place", "label").alias("label"))
        found = stored(found)
        ends = links.join(step.select(F.col("node").alias("a"), F.col("place").alias("pa")), "a") \
            .join(step.select(F.col("node").alias("b"), F.col("place").alias("pb")), "b")
        links = stored(ends.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        if links.isEmpty():
            return found


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` with the components that further ``links`` (a, b) join; nodes may be new."""
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    every = stored(nodes.join(labels, "node", "full").select("node", F.coalesce("label", "node").alias("label")))
    ends = links.join(every.select(F.col("node").alias("a"), F.col("label").alias("la")), "a") \
        .join(every.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    between = stored(ends.where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    if between.isEmpty():
        return every
    moved = components(between).select(F.col("node").alias("label"), F.col("label").alias("place"))
    return every.join(moved, "label", "left").select("node", F.coalesce("place", "label").alias("label"))
