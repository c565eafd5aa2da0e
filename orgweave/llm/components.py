"""Groups of linked records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.shared import cut


def _tops(parents: DataFrame) -> DataFrame:
    """node, up -> the same with up at the end of its chain: each round halves every chain."""
    links = parents
    while True:
        above = links.select(F.col("node").alias("up"), F.col("up").alias("top"))
        nxt = cut(links.hint("merge").join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
        links = nxt.drop("moved")
        if nxt.filter("moved").isEmpty():
            return links


def roots(edges: DataFrame) -> DataFrame:
    """edges(node, owner), owner < node -> node, root: the least node of the group of each node that has an edge.

    Each node first follows its least owner; edges to other owners then join whole groups, until none joins two. Groups of copies are
    stars, so both loops end after a few rounds; no step gathers a group in one task. Nothing is broadcast on an estimate: links grow with the data.
    """
    edges = cut(edges.distinct())
    found = _tops(cut(edges.groupBy("node").agg(F.min("owner").alias("up"))))
    while True:
        known = found.select(F.col("node").alias("x"), F.col("up").alias("root"))
        a = edges.hint("merge").join(known, edges["node"] == F.col("x"), "left").select("owner", F.coalesce("root", "node").alias("ra"))
        both = a.hint("merge").join(known, a["owner"] == F.col("x"), "left").select("ra", F.coalesce("root", "owner").alias("rb")).filter("ra <> rb").distinct()
        merges = cut(both.select(F.greatest("ra", "rb").alias("node"), F.least("ra", "rb").alias("up")).groupBy("node").agg(F.min("up").alias("up")))
        if merges.isEmpty():
            return found.select("node", F.col("up").alias("root"))
        tops = _tops(merges)
        moved = found.hint("merge").join(tops.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left").select("node",
            F.coalesce("top", "up").alias("up"))
        found = cut(moved.unionByName(tops.hint("merge").join(found.select("node"), "node", "left_anti")))
