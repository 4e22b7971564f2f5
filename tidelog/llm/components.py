"""Connected components by alternating large and small stars; of a forest, by jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the least node around: larger ones, or the rest. An edge may come twice.

    The least neighbour is pre-aggregated, one row a node, and joined back, so
    that no node's neighbours have to meet in one task.
    """
    if large:
        edges = _both_ways(edges)
    else:
        edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = edges.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b")


def _settled(edges: DataFrame) -> bool:
    """True if the edges are stars around their least nodes: whoever has a smaller neighbour has no other one."""
    ends = _both_ways(edges).groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
    return not ends.filter("low < a and low < high").agg(F.count("*")).first()[0]


def hung(edges: DataFrame) -> DataFrame:
    """`node, root` for every node of the edges `a, b` that isn't a root; a root is its component's least node.

    Each round is written to the shared folder; rounds end when the edges are
    stars, after about log(nodes) of them. Only a count reaches the driver.
    """
    now = edges.select("a", "b").filter("a <> b")
    while True:
        now = cut(_star(_star(now, large=True), large=False).distinct(), "edges")
        if _settled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """`node, root` for every node of the edges `a, b`, roots included."""
    found = hung(edges)
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def forest_roots(parents: DataFrame) -> DataFrame:
    """`node, root` for nodes that have one parent each, given as `node, root`, without circles.

    A round takes each node to its parent's parent, so that there are about
    log(depth) of them, each a join of one row a node.
    """
    now = parents
    while True:
        above = now.select(F.col("node").alias("root"), F.col("root").alias("above"))
        now = cut(now.select("node", "root").join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        if now.filter("moved").isEmpty():
            return now.select("node", "root")
        now = now.select("node", "root")
