"""Connected components of a link table by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _jump(parents: DataFrame) -> DataFrame:
    up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
    return parents.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that a link (a, b) touches; the component
    is its smallest node.

    Each round hooks every node to its smallest neighbour below it, shortens the
    paths twice, renames the links' ends and keeps the links that still join two
    names. All links stay in play until both ends have one name, so no hooking
    order loses one; each round is written to the shared folder.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = stored(edges, "links")
    first, rounds = edges, []
    while not edges.isEmpty():
        # written before the jumps: a hub that many nodes share is then a plain join key, whose rows can be split
        hooks = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")), "hooks")
        parents = stored(_jump(_jump(hooks)), "parents")
        rounds.append(parents)
        renamed = edges
        for end in ("a", "b"):
            up = parents.select(F.col("node").alias(end), F.col("parent").alias("_up"))
            renamed = renamed.join(up, end, "left").withColumn(end, F.coalesce("_up", end)).drop("_up")
        renamed = stored(renamed.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        discard(hooks, *([edges] if edges is not first else []))
        edges = renamed
    names = first.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    for parents in rounds:
        up = parents.select(F.col("node").alias("component"), F.col("parent").alias("_up"))
        names = names.join(up, "component", "left").select("node", F.coalesce("_up", "component").alias("component"))
    out = stored(names, "components")
    discard(first, *rounds, *([edges] if edges is not first else []))
    return out
