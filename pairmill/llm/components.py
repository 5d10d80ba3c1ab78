"""Connected components of a link table, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmill.llm import common


def _flat(parents: DataFrame, name: str) -> DataFrame:
    """(node, parent) with every node hung on its tree's root; each pass halves the depths."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("over"))
        moved = parents.join(up, "parent").select("node", F.col("over").alias("parent"), (F.col("over") != F.col("parent")).alias("moved"))
        out = common.written(moved, f"{name}-up")
        common.dropped(parents)
        parents = out
        if out.where("moved").isEmpty():
            return parents


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, label): the least node that each node of links (a, b) reaches.

    In every round each node hangs itself on its least neighbour, the trees
    that arise are made flat and become single nodes of the links that are
    left. Only a node less than all its neighbours stays, so at least half of
    the linked nodes go in a round: there is no limit on rounds and a chain
    of n nodes takes about log n. Only whether rows are left comes to the
    driver.
    """
    edges = common.written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-links")
    hung: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("parent"))
        roots = _flat(common.written(least, f"{name}-least"), name).select("node", "parent")
        hung.append(roots)
        on = lambda side, to: roots.select(F.col("node").alias(side), F.col("parent").alias(to))  # noqa: E731, B023
        next_ = edges.join(on("a", "x"), "a").join(on("b", "y"), "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        left = common.written(next_, f"{name}-links")
        common.dropped(edges)
        edges = left
    if not hung:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("label"))
    labels = hung[0].withColumnRenamed("parent", "label")
    for up in hung[1:]:
        over = up.select(F.col("node").alias("label"), F.col("parent").alias("over"))
        labels = labels.join(over, "label", "left").select("node", F.coalesce("over", "label").alias("label"))
    return labels
