"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a > b): each node's larger (large) or smaller neighbours are linked to the least node around it."""
    if large:
        around = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = links
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = around.join(least, "a")
    if large:
        return moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return moved.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a > b").distinct()


def _settled(links: DataFrame) -> bool:
    """Whether links (a > b, distinct) are stars around their least nodes: none is linked to two others, or to one that is linked on."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 or (up = 1 and down = 1)").agg(F.count("*")).first()[0] == 0


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): for every node in links (columns a, b: long), the least node of its component.

    Only counts reach the driver; each round is written to the shared folder. Raises if it has not settled after
    `rounds`, which the logarithmic bound of the method leaves far behind.
    """
    return _solved(materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"), rounds)


def _solved(links: DataFrame, rounds: int = 60) -> DataFrame:
    """components() of written links (a > b, distinct)."""
    for _ in range(rounds):
        if _settled(links):
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        links = materialize(_star(_star(links, True), False), "stars")
    raise RuntimeError("the components have not settled")


def between(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """pairs (a, b ...) whose ends are in different components of parts (node, component), with these as pa and pb; a node that parts lacks is its own."""
    of = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"p{end}"))
    out = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return out.withColumns({"pa": F.coalesce("pa", "a"), "pb": F.coalesce("pb", "b")}).where("pa <> pb")


def joined(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after links (a, b) came to those that parts was made of; parts None: there were none before.

    Only the links between components are solved, as links of their least nodes, so what is settled is not gone through again.
    """
    if parts is None:
        return materialize(components(links), "joined")
    met = materialize(between(links, parts).select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct(), "between")
    if met.isEmpty():
        return parts
    over = materialize(_solved(met), "over").select(F.col("node").alias("component"), F.col("component").alias("to"))
    moved = parts.join(over, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    new = over.select(F.col("component").alias("node"), F.col("to").alias("component")).join(parts.select("node"), "node", "left_anti")
    return materialize(moved.unionByName(new), "joined")
