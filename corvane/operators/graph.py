"""The tag hierarchy: closure, propagation, edits and merges, all over one edge table (child, parent)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.reach import Delta, closure, closure_delta, components, held_delta, reached, with_delta, without  # noqa: F401 - part of this module's interface
from corvane.session import BROADCAST_ROWS, among, cut, dealt, probed, union

def below(edges: DataFrame, ids: list) -> DataFrame:
    """(root, tag): the asked tags and everything under each, once. Only what hangs under them is walked; cycles end."""
    start = edges.sparkSession.createDataFrame([(i, i) for i in dict.fromkeys(ids)], "root string, node string")
    return reached(start, edges.select(F.col("parent").alias("src"), F.col("child").alias("dst"))).select("root", F.col("node").alias("tag"))


def with_tags_chosen(rows: DataFrame, members: DataFrame, edges: DataFrame, choice, owner: str, tag: str = "tag_id") -> DataFrame:
    """rows whose tags (members: owner, tag) pass a TagChoice, by semi and anti joins on the pairs that were asked for."""

    def holding_all(pairs: DataFrame, what: str, n: int) -> DataFrame:
        return pairs.groupBy(owner).agg(F.count_distinct(what).alias("n")).where(F.col("n") == n).select(owner)

    held = members.select(owner, F.col(tag).alias("_tag"))
    if choice.none_of:
        rows = rows.join(among(held, "_tag", choice.none_of).select(owner), owner, "left_anti")
    if choice.any_of:
        rows = rows.join(among(held, "_tag", choice.any_of).select(owner), owner, "left_semi")
    if choice.all_of:
        rows = rows.join(holding_all(among(held, "_tag", choice.all_of), "_tag", len(set(choice.all_of))), owner, "left_semi")
    if choice.none_of_desc:
        under = below(edges, list(choice.none_of_desc))
        rows = rows.join(held.join(under.select(F.col("tag").alias("_tag")).distinct(), "_tag").select(owner), owner, "left_anti")
    if choice.all_of_desc:
        under = below(edges, list(choice.all_of_desc)).withColumnRenamed("tag", "_tag")
        rows = rows.join(holding_all(held.join(under, "_tag"), "root", len(set(choice.all_of_desc))), owner, "left_semi")
    return rows


def propagate(members: DataFrame, closed: DataFrame, owner: str, tag: str = "tag_id") -> DataFrame:
    """(owner, tag): each owner's tags and all their ancestors, once each; rows of an owner lie together.

    Rows are dealt by owner once, before the distinct: it then needs no shuffle of its own, nor do joins and groups by owner after it.
    """
    return lined(members.select(owner, tag), closed, owner, tag).select(owner, F.explode("_line").alias(tag)).distinct()


def held(members: DataFrame, closed: DataFrame, owner: str, tag: str = "tag_id") -> DataFrame:
    """(owner, tag, own, held): each owner's own tags and those of propagate(), once each; own: it has the tag itself, held: closed names it. Rows of an owner lie together."""
    mark = lambda t, own: F.struct(t.alias("tag"), F.lit(own).alias("own"), F.lit(not own).alias("held"))
    above = F.transform(F.coalesce("_line", F.array().cast("array<string>")), lambda a: mark(a, False))
    rows = lined(members.select(owner, tag), closed, owner, tag).select(owner, F.explode(F.concat(F.array(mark(F.col(tag), True)), above)).alias("_x"))
    return rows.groupBy(owner, F.col("_x.tag").alias(tag)).agg(F.bool_or("_x.own").alias("own"), F.bool_or("_x.held").alias("held"))


def lined(members: DataFrame, closed: DataFrame, owner: str, tag: str = "tag_id") -> DataFrame:
    """members with _line, the list of all that closed (tag, ancestor) names above their tag, dealt by owner; null where it names none.

    What moves is a tag, not its ancestors: these come from a broadcast, where tags are few, else from one of the lists
    that tags have in common, by its number. Where lists are many too, they move with their tags.
    """
    few = lambda df: df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    each = cut(closed.groupBy(F.col("tag").alias("_tag")).agg(F.array_distinct(F.collect_list("ancestor")).alias("_line")))
    rows, named = members.withColumnRenamed(tag, "_tag"), [F.col("_tag").alias(tag) if c == tag else F.col(c) for c in members.columns] + [F.col("_line")]
    if few(each):
        return dealt(rows, owner).join(F.broadcast(each), "_tag", "left").select(*named)
    above = F.array_sort(F.array_remove("_line", F.col("_tag")))
    groups = cut(each.select(above.alias("_above")).distinct().withColumn("_group", F.monotonically_increasing_id()))
    if not few(groups):
        return dealt(rows.join(each.hint("shuffle_hash"), "_tag", "left").select(*named), owner)
    groups = F.broadcast(groups)
    of = each.select("_tag", above.alias("_above"), F.array_contains("_line", F.col("_tag")).alias("_self")).join(groups, "_above").select("_tag", "_self", "_group")
    near = dealt(rows.join(of.hint("shuffle_hash"), "_tag", "left"), owner).join(groups, "_group", "left")
    return near.withColumn("_line", F.when(F.col("_self"), F.concat(F.array("_tag"), "_above")).otherwise(F.col("_above"))).select(*named)


def materialised(pairs: DataFrame, owner: str, tag: str = "tag_id") -> DataFrame:
    """The array view of (owner, tag) pairs, sorted."""
    return pairs.groupBy(owner).agg(F.sort_array(F.collect_set(tag)).alias("tag_ids"))


def relations(edges: DataFrame, tag_ids: list) -> DataFrame:
    """(tag, relative, kind): children and parents of some tags."""
    down = among(edges, "parent", tag_ids).select(F.col("parent").alias("tag"), F.col("child").alias("relative"), F.lit("child").alias("kind"))
    up = among(edges, "child", tag_ids).select(F.col("child").alias("tag"), F.col("parent").alias("relative"), F.lit("parent").alias("kind"))
    return down.unionByName(up).distinct()


def one_sided(child_lists: DataFrame, parent_lists: DataFrame) -> DataFrame:
    """Edges (child, parent) that stand in the lists of one side only, with the side that lacks them."""
    a = child_lists.join(parent_lists, ["child", "parent"], "left_anti").withColumn("missing_in", F.lit("parents"))
    return a.unionByName(parent_lists.join(child_lists, ["child", "parent"], "left_anti").withColumn("missing_in", F.lit("children")))


def repaired(child_lists: DataFrame, parent_lists: DataFrame) -> DataFrame:
    return child_lists.unionByName(parent_lists).where("child <> parent").distinct()


def guard(candidates: DataFrame, closed: DataFrame) -> DataFrame:
    """candidates (tag, child) with is_valid: a child must be no ancestor of the tag, itself included; one bad child spoils all edits of its tag."""
    bad = candidates.join(closed, (candidates["tag"] == closed["tag"]) & (candidates["child"] == closed["ancestor"]), "left_semi").select("tag").distinct()
    return candidates.join(bad.withColumn("_bad", F.lit(True)), "tag", "left").select("tag", "child", F.col("_bad").isNull().alias("is_valid"))


def with_edits(edges: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    return edges.select("child", "parent").unionByName(added.select("child", "parent")).distinct().join(removed.select("child", "parent"), ["child", "parent"], "left_anti")


def without_tags(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those of deleted tags (tag_id)."""
    return edges.join(gone.select(F.col("tag_id").alias("child")), "child", "left_anti").join(gone.select(F.col("tag_id").alias("parent")), "parent", "left_anti").select("child", "parent")


def resolved_merges(merges: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(gone, kept) where kept is what is left in the end: chains and merges that share a tag come together as components.

    In each component the tag stays that goes in no merge; of several that with the highest count (counts: tag_id, count),
    then the least id, and the others go too. Where none is left, the merges are a cycle and a ValueError is raised.
    """
    pairs = merges.select("gone", "kept").where("gone <> kept").distinct()
    parts = components(pairs.select(F.col("gone").alias("a"), F.col("kept").alias("b")))
    marked = parts.join(pairs.select(F.col("gone").alias("node"), F.lit(True).alias("_goes")).distinct(), "node", "left")
    if counts is not None:
        marked = marked.join(counts.select(F.col("tag_id").alias("node"), F.col("count").alias("_count")), "node", "left")
    rank = F.coalesce("_count", F.lit(0)) if counts is not None else F.lit(0)
    stays = F.min(F.when(F.col("_goes").isNull(), F.struct((-rank).alias("c"), "node")))["node"]
    chosen = cut(marked.groupBy("root").agg(stays.alias("kept")))
    if not chosen.where("kept is null").isEmpty():
        raise ValueError("merges lead back to a tag that goes")
    return cut(parts.join(chosen, "root").select(F.col("node").alias("gone"), "kept").where("gone <> kept"))


def merged_edges(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Edges after merges (gone, kept), each tag once in gone: ends renamed, loops dropped, once each. For chains see resolved_merges()."""
    m = merges.select("gone", "kept")
    out = edges.join(m, edges["child"] == m["gone"], "left").select(F.coalesce("kept", "child").alias("child"), "parent")
    out = out.join(m, out["parent"] == m["gone"], "left").select("child", F.coalesce("kept", "parent").alias("parent"))
    return out.where("child <> parent").distinct()


def merged_members(members: DataFrame, merges: DataFrame, owner: str, tag: str = "tag_id") -> DataFrame:
    m = probed(merges.select("gone", "kept"))
    return dealt(members.join(m, members[tag] == m["gone"], "left").select(owner, F.coalesce("kept", tag).alias(tag)), owner).distinct()


def leading_where(closed: DataFrame, tag_ids: list) -> DataFrame:
    """Pairs of the closure whose ancestor is above one of some tags: all that counts of their ancestors need."""
    above = cut(among(closed, "tag", tag_ids).where("depth > 0").select("ancestor").distinct())
    return closed.join(above, "ancestor", "left_semi").select(*closed.columns)


def ancestor_labels(closed: DataFrame, tags: DataFrame, counts: DataFrame, tag_ids: list) -> DataFrame:
    """(tag, ancestor, label, n_files, place): ancestors of some tags without themselves, those with most files first; counts: (tag_id, n_files)."""
    rows = among(closed, "tag", tag_ids).where(F.col("depth") > 0).join(tags.select(F.col("tag_id").alias("ancestor"), "label"), "ancestor")
    rows = rows.join(counts.select(F.col("tag_id").alias("ancestor"), "n_files"), "ancestor", "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("n_files"), "ancestor"))
    return rows.select("tag", "ancestor", "label", "n_files", place.cast("long").alias("place"))


def merge_candidates(edges: DataFrame, closed: DataFrame, tag_ids: list) -> DataFrame:
    """Relatives (relative, kind) of tags to be merged, without those tags and without ancestors of other candidates of the same kind."""
    found = among(relations(edges, tag_ids), "relative", tag_ids, keep=False).select("relative", "kind").distinct()
    other = found.select(F.col("relative").alias("o"), F.col("kind").alias("k"))
    covers = closed.where("depth > 0").join(other, closed["tag"] == other["o"]).select(F.col("ancestor").alias("relative"), F.col("k").alias("kind")).distinct()
    return found.join(covers, ["relative", "kind"], "left_anti")


def drop_ancestors(members: DataFrame, closed: DataFrame, owner: str, tag: str = "tag_id") -> DataFrame:
    """The (owner, tag) rows of members without tags that are ancestors of another tag of the same owner.

    Rows go to their owner with the list of what is above them; there a tag stays that stands in no list. No pair is sorted or joined.
    """
    held = lined(members.select(owner, tag), closed.where("depth > 0"), owner, tag)
    mark = lambda t, own: F.struct(t.alias("tag"), F.lit(own).alias("own"))
    others = F.when(F.col(owner).isNotNull() & F.col("_line").isNotNull(), F.transform("_line", lambda a: mark(a, 0))).otherwise(F.array().cast(f"array<struct<tag:{dict(members.dtypes)[tag]},own:int>>"))
    each = held.select(owner, F.explode(F.concat(F.array(mark(F.col(tag), 1)), others)).alias("_x")).select(owner, F.col("_x.tag").alias(tag), F.col("_x.own").alias("_own"))
    left = each.groupBy(owner, tag).agg(F.sum("_own").alias("_n"), F.min("_own").alias("_only")).where("_only = 1")
    return left.select(owner, tag, F.explode(F.array_repeat(F.lit(1), F.col("_n").cast("int"))).alias("_i")).select(owner, tag)


def inherit_category(tags: DataFrame, closed: DataFrame) -> DataFrame:
    """tags (tag_id, color, icon, sort_rank, inheritable) with what inheritable ancestors hand down.

    Ancestors come by depth, then id. One of higher rank than all before gives rank, colour and icon; another only what
    is still missing. A missing own rank takes no part; where there is no category at all, pass has_rank = false.
    """
    t = tags.select("tag_id", "color", "icon", "sort_rank", "has_rank")
    above = closed.where("depth > 0").join(tags.where("inheritable").select(F.col("tag_id").alias("ancestor"), *(F.col(c).alias(f"a_{c}") for c in ("color", "icon", "sort_rank"))), "ancestor")
    lists = above.groupBy(F.col("tag").alias("tag_id")).agg(F.array_sort(F.collect_list(F.struct("depth", "ancestor", "a_color", "a_icon", "a_sort_rank"))).alias("line"))
    rows = t.join(lists, "tag_id", "left").withColumn("line", F.coalesce("line", F.array().cast("array<struct<depth:int,ancestor:string,a_color:string,a_icon:string,a_sort_rank:double>>")))
    start = F.struct(F.col("sort_rank").cast("double").alias("rank"), F.col("color").cast("string").alias("color"), F.col("icon").cast("string").alias("icon"))

    def step(s, x):
        wins = F.col("has_rank") & (F.coalesce(x["a_sort_rank"], F.lit(0.0)) > F.coalesce(s["rank"], F.lit(0.0)))
        fill = lambda own, theirs: F.when(F.coalesce(own, F.lit("")) == "", theirs).otherwise(own)
        return F.struct(F.when(wins, x["a_sort_rank"]).otherwise(s["rank"]).alias("rank"), F.when(wins, x["a_color"]).otherwise(fill(s["color"], x["a_color"])).alias("color"), F.when(wins, x["a_icon"]).otherwise(fill(s["icon"], x["a_icon"])).alias("icon"))

    out = rows.withColumn("got", F.aggregate("line", start, step))
    return out.select("tag_id", F.col("got.color").alias("color"), F.col("got.icon").alias("icon"), F.col("got.rank").alias("sort_rank"))


def tree(labels: DataFrame) -> DataFrame:
    """(label, path, depth) from labels with parents (label, parent_label), case aside: roots have none, and each label
    stands under every path of its parents; the least spelling of a label counts. No path holds a label twice, so what
    hangs in a cycle under a root ends before it would come again; cycles that no root leads to have no path."""
    rows = labels.select(F.lower("label").alias("key"), "label", F.lower("parent_label").alias("up"))
    spelled = rows.groupBy("key").agg(F.min("label").alias("label"), F.max("up").alias("any_up"))
    links = cut(rows.where("up is not null and up <> key").select("key", "up").distinct().join(spelled.select("key", "label"), "key"))
    level = cut(spelled.where("any_up is null").select("key", "label", F.col("label").alias("path"), F.array("key").alias("keys"), F.lit(0).alias("depth")))
    found = []
    while not level.isEmpty():
        found.append(level.select("label", "path", "depth"))
        above = level.select(F.col("key").alias("up"), F.col("path").alias("_path"), F.col("keys").alias("_keys"), "depth")
        step = links.join(above, "up").where(~F.array_contains("_keys", F.col("key")))
        level = cut(step.select("key", "label", F.concat("_path", F.lit("/"), "label").alias("path"), F.array_append("_keys", F.col("key")).alias("keys"), (F.col("depth") + 1).alias("depth")))
    return union(found) if found else level.select("label", "path", "depth")


def paths_to_tags(paths: DataFrame, col: str = "path") -> DataFrame:
    """(label, parent_label, depth): the hierarchy in slash-separated paths; the tag before is the parent, roots have none."""
    parts = F.filter(F.split(col, "/"), lambda p: p != "")
    rows = paths.select(F.posexplode(parts).alias("depth", "label"), parts.alias("parts"))
    return rows.select("label", F.when(F.col("depth") > 0, F.get("parts", F.col("depth") - 1)).alias("parent_label"), "depth").distinct()
