"""What can be reached over links: closures of any depth in few rounds, kept up to date under edits, and components."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import BROADCAST_ROWS, cut, probed, union

#: Rounds that follow links one by one, as most hierarchies ask for no more; beyond them the steps double.
SHALLOW = 6


def reached(start: DataFrame, links: DataFrame) -> DataFrame:
    """(root, node): start (root, node) and all that links (src, dst) lead to from there, once each; cycles end.

    A few rounds go link by link from what was found last. What lies deeper is reached by jumps of 1, 2, 4 ... links, so a
    chain of a million takes some twenty rounds more. A round that finds nothing new is the last.
    """
    links = links.select("src", "dst").where("src <> dst").distinct()
    seen = fresh = cut(start.select("root", "node").distinct())
    for _ in range(SHALLOW):
        step = fresh.join(links, fresh["node"] == links["src"]).select("root", F.col("dst").alias("node")).distinct()
        fresh = cut(step.join(seen, ["root", "node"], "left_anti"))
        if fresh.isEmpty():
            return seen
        seen = seen.unionByName(fresh)
    jumps = cut(links)
    while True:
        step = seen.join(jumps, seen["node"] == jumps["src"]).select("root", F.col("dst").alias("node")).distinct()
        fresh = cut(step.join(seen, ["root", "node"], "left_anti"))
        if fresh.isEmpty():
            return seen
        seen = cut(seen.unionByName(fresh))
        onward = jumps.select(F.col("src").alias("dst"), F.col("dst").alias("_next"))
        jumps = cut(jumps.join(onward, "dst").select("src", F.col("_next").alias("dst")).where("src <> dst").distinct())


def closure(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(tag, ancestor, depth) of edges (child, parent), with every tag's self at depth 0 and the least depth of all paths.

    Steps double: pairs at just 2^k steps, met with all that are nearer, give those at up to 2^(k+1). So the rounds are the
    logarithm of the depth, and each pair is found by way of the tags half-way only. Cycles end: their tags are each
    other's ancestors. nodes (tag_id) adds tags without edges.
    """
    links = edges.select(F.col("child").alias("tag"), F.col("parent").alias("ancestor")).where("tag <> ancestor").distinct()
    tags = edges.select(F.explode(F.array("child", "parent")).alias("tag"))
    tags = (tags.unionByName(nodes.select(F.col("tag_id").alias("tag"))) if nodes is not None else tags).where("tag is not null").distinct()
    # All pairs nearer than `span`, and those at exactly `span`.
    near = cut(tags.select("tag", F.col("tag").alias("ancestor"), F.lit(0).alias("depth")).unionByName(links.withColumn("depth", F.lit(1))))
    direct, span = near.where("depth = 1"), 2
    edge = cut(_composed(direct, direct).join(near, ["tag", "ancestor"], "left_anti"))
    while not edge.isEmpty():
        beyond = near.select(F.col("tag").alias("_via"), F.col("ancestor").alias("_far"), "depth")
        step = edge.select("tag", "ancestor").join(beyond, F.col("ancestor") == F.col("_via")).groupBy("tag", F.col("_far").alias("ancestor")).agg((F.min("depth") + span).cast("int").alias("depth"))
        near = near.unionByName(cut(step.join(near, ["tag", "ancestor"], "left_anti")))
        span *= 2
        edge = cut(_composed(edge, edge).join(near, ["tag", "ancestor"], "left_anti"))
    return near


def _composed(a: DataFrame, b: DataFrame) -> DataFrame:
    """(tag, ancestor) of a step by a and one by b."""
    second = b.select(F.col("tag").alias("_via"), F.col("ancestor").alias("_far"))
    return a.join(second, a["ancestor"] == second["_via"]).select("tag", F.col("_far").alias("ancestor")).distinct()


@dataclass(frozen=True)
class Delta:
    """Pairs that came and pairs that went."""

    added: DataFrame
    removed: DataFrame


#: Values of the last column up to which with_delta() sends past the removed pairs what cannot be among them.
FEW = 10_000


def with_delta(pairs: DataFrame, delta: Delta) -> DataFrame:
    """pairs without the removed and with the added. Where the removed pairs name few ancestors or tags (the last column), only pairs with those meet them."""
    names = delta.added.columns
    rows, removed = pairs.select(*names), delta.removed
    few = cut(removed.select(names[-1]).distinct().limit(FEW + 1))
    if few.count() > FEW:
        return rows.join(removed, names, "left_anti").unionByName(delta.added)
    few = F.broadcast(few)
    return union([rows.join(few, names[-1], "left_anti").select(*names), rows.join(few, names[-1], "left_semi").join(removed, names, "left_anti").select(*names), delta.added])


def without(pairs: DataFrame, removed: DataFrame) -> list[DataFrame]:
    """pairs without the removed, in one part or two: few removed pairs go to where the others lie; of more only those with a tag (the last column) that is named among them meet them."""
    names = pairs.columns
    if removed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return [pairs.join(F.broadcast(removed), names, "left_anti")]
    few = cut(removed.select(names[-1]).distinct().limit(FEW + 1))
    if few.count() > FEW:
        return [pairs.join(removed, names, "left_anti")]
    few = F.broadcast(few)
    return [pairs.join(few, names[-1], "left_anti").select(*names), pairs.join(few, names[-1], "left_semi").join(removed, names, "left_anti").select(*names)]


def closure_delta(closed: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame) -> Delta:
    """What becomes of the closure (tag, ancestor, selves included) of edges when some (child, parent) are added and some removed.

    An edge that is in both lists goes. Removal: pairs with a path over an edge that goes are taken out, then those that
    still have a path are put back, from the ones with an edge to a pair that is sure. Insertion: all below each new
    edge's child, itself included, meets all above its parent; where new edges lead to one another their upper sides are
    joined first. Work is in proportion to the pairs with such paths, not to the closure, which is only looked up. Tags that no
    edge names any more keep their own pair; new tags get one.
    """
    ends = ["child", "parent"]
    pairs = closed.select("tag", "ancestor")
    was = edges.select(*ends).where("child <> parent").distinct()
    gone = cut(was.join(removed.select(*ends), ends, "left_semi"))
    kept = was.join(removed.select(*ends), ends, "left_anti")
    fresh = cut(added.select(*ends).where("child <> parent").distinct().join(removed.select(*ends), ends, "left_anti").join(was, ends, "left_anti"))
    lost = _lost(pairs, kept, gone)
    named = fresh.select(F.explode(F.array(*ends)).alias("tag")).distinct()
    selves = cut(named.join(_among(pairs, "tag", named).select("tag"), "tag", "left_anti").withColumn("ancestor", F.col("tag")))
    left = union([*without(pairs, lost), selves])
    gained = cut(_gained(left, fresh).unionByName(selves))
    return Delta(gained.join(lost, ["tag", "ancestor"], "left_anti"), cut(lost.join(gained, ["tag", "ancestor"], "left_anti")))


def _among(pairs: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Pairs whose column is in names (one column); where these are few, they go to the pairs, which stay where they lie."""
    return pairs.join(probed(names.toDF(column).distinct()), column, "left_semi").select(*pairs.columns)


def _lost(pairs: DataFrame, kept: DataFrame, gone: DataFrame) -> DataFrame:
    """Pairs of the closure that have no path left once the edges in gone are taken out."""
    low = pairs.select("tag", F.col("ancestor").alias("child")).join(probed(gone), "child").select("tag", F.col("parent").alias("_via"))
    high = cut(_among(pairs, "tag", gone.select("parent"))).select(F.col("tag").alias("_via"), "ancestor")
    doubted = cut(low.distinct().join(probed(high), "_via").select("tag", "ancestor").where("tag <> ancestor").distinct())
    # Over the edges that stay: from each doubted pair to the pair one step further up.
    onward = cut(doubted.join(kept.select(F.col("child").alias("tag"), F.col("parent").alias("_via")), "tag"))
    further = onward.select("tag", "ancestor", "_via")
    inside = doubted.select(F.col("tag").alias("_via"), "ancestor")
    sure = further.join(_among(pairs, "ancestor", doubted.select("ancestor")).select(F.col("tag").alias("_via"), "ancestor"), ["_via", "ancestor"], "left_semi").join(inside, ["_via", "ancestor"], "left_anti")
    node = F.struct("tag", "ancestor")
    links = further.join(inside, ["_via", "ancestor"], "left_semi").select(F.struct(F.col("_via").alias("tag"), "ancestor").alias("src"), node.alias("dst"))
    back = reached(sure.select(F.lit(0).alias("root"), node.alias("node")), links).select("node.tag", "node.ancestor")
    return cut(doubted.join(back, ["tag", "ancestor"], "left_anti"))


def _gained(left: DataFrame, fresh: DataFrame) -> DataFrame:
    """Pairs that new edges add to a closure."""
    above = _among(left, "tag", fresh.select("parent")).select(F.col("tag").alias("parent"), "ancestor")
    own = cut(fresh.join(above, "parent").select("child", "ancestor").distinct())
    # New edges whose parent leads to the child of another.
    hops = own.join(fresh.select(F.col("child").alias("ancestor")).distinct(), "ancestor").select(F.col("child").alias("src"), F.col("ancestor").alias("dst"))
    through = reached(fresh.select(F.col("child").alias("root"), F.col("child").alias("node")), hops)
    tops = cut(through.join(own, F.col("node") == F.col("child")).select(F.col("root").alias("child"), F.col("ancestor").alias("_far")).distinct())
    met = left.select("tag", F.col("ancestor").alias("child")).join(probed(tops), "child").select("tag", F.col("_far").alias("ancestor")).distinct()
    return met.join(_among(left, "ancestor", tops.select("_far")), ["tag", "ancestor"], "left_anti")


def held_delta(members: DataFrame, before: DataFrame, after: DataFrame, delta: Delta, owner: str, tag: str = "tag_id", touched: DataFrame | None = None) -> Delta:
    """What becomes of propagate(members): (owner, tag) pairs that a change of the closure from before to after adds and takes away.

    An owner gains an ancestor that none of its tags had, and loses one that none has any more. Only owners with a tag
    whose pairs changed are looked at. Pairs come marked as added, removed or kept, so that each owner's tags meet them once; of
    the kept ones only those to an ancestor that the delta names take part. touched: owners (owner) that are known to be all with such a tag, or more; members, which should be stored, then stay where they lie.
    """
    names = ["tag", "ancestor"]
    came, went = cut(delta.added.select(*names)), cut(delta.removed.select(*names))
    both = came.unionByName(went)
    kept = _among(before.select(*names), "ancestor", both.select("ancestor")).join(went, names, "left_anti").select(*names)
    marks = [pairs.select(*names, *(F.lit(name == m).alias(m) for m in ("_came", "_went", "_kept"))) for name, pairs in (("_came", came), ("_went", went), ("_kept", kept))]
    own = members.select(owner, F.col(tag).alias("tag"))
    if touched is None:
        own = cut(own)
        touched = cut(own.join(both.select("tag").distinct(), "tag", "left_semi").select(owner).distinct())
    asked = own.join(probed(touched), owner, "left_semi")
    held = asked.join(cut(union(marks)), "tag").groupBy(owner, F.col("ancestor").alias(tag)).agg(*(F.bool_or(m).alias(m) for m in ("_came", "_went", "_kept")))
    changed = cut(held.where("not _kept and _came <> _went"))
    return Delta(changed.where("_came").select(owner, tag), changed.where("_went").select(owner, tag))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component of links (a, b), for every node that a link names.

    Each round a node takes the least root among its neighbours' and then that root's own root, until nothing changes.
    """
    both = cut(links.select("a", "b").where("a <> b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct())
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct()
    at = cut(nodes.select("node", F.col("node").alias("root")))
    while True:
        near = both.join(at.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("_near"))
        # The root of a node is told what its nodes have heard, so that whole components move at once.
        heard = at.join(near, "node", "left").withColumn("_low", F.least("root", F.coalesce("_near", "root")))
        told = heard.groupBy(F.col("root").alias("_root")).agg(F.min("_low").alias("_told"))
        moved = cut(heard.join(told, heard["root"] == told["_root"]).select("node", F.col("root").alias("_was"), F.least("_low", "_told").alias("root")))
        ahead = moved.select(F.col("node").alias("_via"), F.col("root").alias("_next"))
        at = cut(moved.join(ahead, moved["root"] == ahead["_via"]).select("node", F.least("root", "_next").alias("root"), "_was"))
        if at.where("root <> _was").isEmpty():
            return at.select("node", "root")
        at = at.select("node", "root")
