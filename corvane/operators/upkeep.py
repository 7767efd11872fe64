"""Changes of the tag hierarchy and what follows from them, as new frames of the same tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import graph, mutate, rollups
from corvane.session import BROADCAST_ROWS, bucketed, cut, dealt, probed, union


@dataclass(frozen=True)
class TagTables:
    """tags (tag_id, label, aliases, regex ...), edges (child, parent), and who holds what: (file_id | collection_id | batch_id, tag_id)."""

    tags: DataFrame
    edges: DataFrame
    file_tags: DataFrame
    collection_tags: DataFrame
    batch_tags: DataFrame


def _edges(spark, pairs: list[tuple]) -> DataFrame:
    return spark.createDataFrame(pairs, "child string, parent string")


def created(t: TagTables, tag_id: str, label: str, parents: tuple = (), children: tuple = (), **values) -> TagTables:
    """With a new tag under its parents and over its children."""
    spark = t.tags.sparkSession
    row = spark.createDataFrame([(tag_id, label)], "tag_id string, label string").withColumns({k: F.lit(v) for k, v in values.items()})
    links = [(tag_id, p) for p in parents] + [(c, tag_id) for c in children]
    return replace(t, tags=mutate.insert(t.tags, row), edges=graph.with_edits(t.edges, _edges(spark, links), _edges(spark, [])))


def edited(t: TagTables, tag_id: str, parents: tuple | None = None, children: tuple | None = None, **values) -> TagTables:
    """With new values of a tag; lists that are given replace those that were."""
    spark, edges = t.tags.sparkSession, t.edges
    if parents is not None:
        edges = edges.where(F.col("child") != tag_id).unionByName(_edges(spark, [(tag_id, p) for p in parents]))
    if children is not None:
        edges = edges.where(F.col("parent") != tag_id).unionByName(_edges(spark, [(c, tag_id) for c in children]))
    own = F.col("tag_id") == tag_id
    tags = t.tags.withColumns({k: F.when(own, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()}) if values else t.tags
    return replace(t, tags=tags, edges=edges.distinct())


def deleted(t: TagTables, gone: DataFrame) -> TagTables:
    """Without some tags (tag_id), everywhere."""
    ids = probed(gone.select("tag_id"))
    held = {n: getattr(t, n).join(ids, "tag_id", "left_anti").select(*getattr(t, n).columns) for n in ("file_tags", "collection_tags", "batch_tags")}
    return TagTables(tags=mutate.delete(t.tags, gone.select("tag_id"), "tag_id"), edges=graph.without_tags(t.edges, gone), **held)


def merged(t: TagTables, merges: DataFrame) -> TagTables:
    """After merges (gone, kept): holders keep the kept tag once, edges are renamed, the gone tags go, and what is
    written in merges as label, aliases or regex stands in the kept tag.

    Merges may follow each other and share tags (see graph.resolved_merges()): no row names a tag that is gone. Values come
    from the merge that names the tag that is left, of several from the one with the least gone tag.
    """
    asked, counts = merges, t.tags.select("tag_id", "count") if "count" in t.tags.columns else None
    merges = graph.resolved_merges(merges, counts)
    held = {n: graph.merged_members(getattr(t, n), merges, owner) for n, owner in (("file_tags", "file_id"), ("collection_tags", "collection_id"), ("batch_tags", "batch_id"))}
    tags = mutate.delete(t.tags, merges.select(F.col("gone").alias("tag_id")), "tag_id")
    values = [c for c in ("label", "aliases", "regex") if c in asked.columns]
    if values:
        first = asked.groupBy(F.col("kept").alias("tag_id")).agg(*(F.min_by(c, "gone").alias(c) for c in values))
        tags = mutate.update(tags, first, "tag_id")
    return TagTables(tags=tags, edges=graph.merged_edges(t.edges, merges), **held)


def repaired(t: TagTables) -> TagTables:
    """Labels decoded, and tags whose labels are the same but for case merged into the one held most."""
    decoded = replace(t, tags=t.tags.withColumn("label", text.decode_entities(F.col("label"))))
    return merged(decoded, rollups.merge_plan(decoded.tags))


def related(edges: DataFrame, closed: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(errors, edges) of edits (tag, other, kind, action): kind child or parent, action add or remove.

    A child to be added must be no ancestor of the tag and a parent no descendant, the tag itself included. One bad id
    leaves all edits of its tag undone; errors are the bad ones (tag, other, kind).
    """
    add = edits.where("action = 'add'")
    up, down = F.col("kind") == "child", F.col("kind") == "parent"
    lines = closed.select(F.col("tag").alias("_low"), F.col("ancestor").alias("_high"))
    child = add.where(up).join(lines, (F.col("tag") == F.col("_low")) & (F.col("other") == F.col("_high")), "left_semi")
    parent = add.where(down).join(lines, (F.col("other") == F.col("_low")) & (F.col("tag") == F.col("_high")), "left_semi")
    errors = child.unionByName(parent).select("tag", "other", "kind")
    good = edits.join(errors.select("tag").distinct(), "tag", "left_anti")
    links = good.select(F.when(F.col("kind") == "child", F.col("other")).otherwise(F.col("tag")).alias("child"), F.when(F.col("kind") == "child", F.col("tag")).otherwise(F.col("other")).alias("parent"), "action")
    return errors, graph.with_edits(edges, links.where("action = 'add'"), links.where("action = 'remove'"))


def refreshed(child_lists: DataFrame, parent_lists: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, closure) after both sides of each relation are made to name each other."""
    edges = graph.repaired(child_lists, parent_lists)
    return edges, graph.closure(edges, tags)


def upserted(tags: DataFrame, edges: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tags, edges) where every label of wanted (label, parent_label) has a tag, and those with parents given just these.

    Labels nobody has get tags, parents too, with ids made from the label. A null parent asks for none.
    """
    names = wanted.select("label").union(wanted.select("parent_label")).where("label is not null").distinct()
    known = tags.groupBy("label").agg(F.min("tag_id").alias("tag_id"))
    ids = names.join(known, "label", "left").select("label", F.coalesce("tag_id", F.concat(F.lit("T"), F.md5("label"))).alias("tag_id"), F.col("tag_id").isNull().alias("is_new"))
    links = wanted.where("parent_label is not null").join(ids.select("label", F.col("tag_id").alias("child")), "label").join(ids.select(F.col("label").alias("parent_label"), F.col("tag_id").alias("parent")), "parent_label")
    links = links.select("child", "parent").where("child <> parent").distinct()
    kept = edges.select("child", "parent").join(links.select("child"), "child", "left_anti")
    return mutate.insert(tags, ids.where("is_new").select("tag_id", "label")), kept.unionByName(links).distinct()


@dataclass(frozen=True)
class Derived:
    """What is kept beside the tags: closures and counts."""

    closure: DataFrame
    file_closure: DataFrame
    collection_closure: DataFrame
    rollup: DataFrame


def regenerated(t: TagTables, files: DataFrame) -> Derived:
    """All that follows from the edges, in one go: closure, what files and collections hold with ancestors, counts of tags."""
    closed = graph.closure(t.edges, t.tags)
    wide = graph.propagate(t.file_tags, closed, "file_id")
    return Derived(closed, wide, graph.propagate(t.collection_tags, closed, "collection_id"), rollups.tag_rollup(t.tags, wide, files, once=True))


def _edge_delta(before: TagTables, after: TagTables) -> graph.Delta:
    ends = ["child", "parent"]
    was, now = before.edges.select(*ends).distinct(), after.edges.select(*ends).distinct()
    return graph.Delta(cut(now.join(was, ends, "left_anti")), cut(was.join(now, ends, "left_anti")))


def closure_after(before: TagTables, closed: DataFrame, after: TagTables, edges: graph.Delta | None = None) -> tuple[DataFrame, graph.Delta]:
    """((tag, ancestor), delta): the closure after a change of tags and edges, made from the one before it by what changed (edges, where it is known)."""
    edges = edges or _edge_delta(before, after)
    delta = graph.closure_delta(closed, before.edges.select("child", "parent").distinct(), edges.added, edges.removed)
    self_of = lambda tags: tags.select(F.col("tag_id").alias("tag"), F.col("tag_id").alias("ancestor"))
    old, new = self_of(before.tags), self_of(after.tags)
    named = ["tag", "ancestor"]
    delta = graph.Delta(delta.added.unionByName(new.join(closed.where("tag = ancestor").select(*named), named, "left_anti")).distinct(), delta.removed.unionByName(old.join(new, named, "left_anti")).distinct())
    return graph.with_delta(closed, delta), delta


#: Parts in which a library's pairs may lie before they are written as one table again.
PARTS = 6


@dataclass(frozen=True)
class Library:
    """All tables of a library with what is derived from them, so that one call changes both.

    files (file_id, hash, size, rating, date_created ...), members (collection_id, file_id ...), tombstones (hash); closed
    (tag, ancestor), tag_state and collection_state as in rollups. wide (file_id, tag_id with ancestors) is all parts together: a
    stored table, dealt by file, without what went, and the pairs that came. A change leaves what it does not concern where it lies.
    """

    files: DataFrame
    members: DataFrame
    tombstones: DataFrame
    tags: TagTables
    closed: DataFrame
    parts: tuple[DataFrame, ...]
    tag_state: DataFrame
    collection_state: DataFrame

    @property
    def wide(self) -> DataFrame:
        return union(list(self.parts))


PAIR = ["file_id", "tag_id"]


def library(files: DataFrame, members: DataFrame, tombstones: DataFrame, tags: TagTables) -> Library:
    """The library with everything derived anew, once; the calls below keep it so. Own and derived tags of the files are one stored table; rows of file_tags whose file there is not are left out."""
    closed = graph.closure(tags.edges, tags.tags).select("tag", "ancestor")
    table = bucketed(graph.held(tags.file_tags, closed, "file_id").join(files.select("file_id").hint("shuffle_hash"), "file_id", "left_semi"), "file_id", lies=True)
    own, wide = table.where("own").select(*PAIR), table.where("held").select(*PAIR)
    return Library(files, members, tombstones, replace(tags, file_tags=own), closed, (wide,), cut(rollups.rollup_state(tags.tags, wide, files)), cut(rollups.collection_state(members, files)))


def files_deleted(lib: Library, gone: DataFrame) -> Library:
    """After files (file_id) are deleted: members, own and derived tags, counts of tags and collections, and tombstones follow.

    Collections left without files go; nothing is derived anew but what the deleted files took part in.
    """
    ids = cut(gone.select("file_id").distinct())
    left, members, tombstones = mutate.delete_files(lib.files, lib.members, lib.tombstones, ids)
    away, facts = probed(ids), probed(ids.join(lib.files.select("file_id", "size", "date_created"), "file_id"))
    lost, taken = union([p.join(facts, "file_id") for p in lib.parts]), lib.members.select("collection_id", "file_id").join(ids, "file_id", "left_semi")
    parts = tuple(p.join(away, "file_id", "left_anti") for p in lib.parts)
    own = lib.tags.file_tags
    return replace(
        lib, files=left, members=members, tombstones=tombstones, tags=replace(lib.tags, file_tags=own.join(away, "file_id", "left_anti").select(*own.columns)), parts=parts,
        tag_state=rollups.rolled(lib.tag_state, graph.Delta(lost.limit(0), lost), lib.files, left, parts), collection_state=cut(rollups.collections_rolled(lib.collection_state, graph.Delta(taken.limit(0), taken), lib.files, left)),
    )


def files_retagged(lib: Library, files: DataFrame, added: list, removed: list) -> Library:
    """After tags are put on and then taken off some files (file_id): their ancestors and the counts of all tags concerned follow."""
    ids = cut(files.select("file_id").distinct().join(lib.files.select("file_id"), "file_id", "left_semi"))
    own, asked = lib.tags.file_tags.select(*PAIR), probed(ids)
    part = cut(retagged(own.join(asked, "file_id", "left_semi"), ids, added, removed))
    delta = _difference(lib.wide.join(asked, "file_id", "left_semi"), graph.propagate(part, lib.closed, "file_id"))
    return _with_wide(replace(lib, tags=replace(lib.tags, file_tags=own.join(asked, "file_id", "left_anti").unionByName(part))), delta)


def tags_changed(lib: Library, after: TagTables) -> Library:
    """After a change of tags and edges (created(), edited(), deleted(), merged() ...): closure, files' ancestors and counts follow by what changed.

    Where the change took tags from files or gave them others, as a merge does, these files are looked at too.
    """
    edges = _edge_delta(lib.tags, after)
    closed, delta = closure_after(lib.tags, lib.closed, after, edges)
    closed = cut(closed)
    before, touched = lib.tags.file_tags.select(*PAIR), _touched(lib, after, edges)
    if lib.tags.file_tags.sameSemantics(after.file_tags):
        return _with_state(_with_wide(replace(lib, tags=after, closed=closed), graph.held_delta(before, lib.closed, closed, delta, "file_id", touched=touched)), lib.tags)
    now = after.file_tags.select(*PAIR).distinct()
    moved = cut(changed(before, now, "file_id"))
    by_closure = graph.held_delta(before.join(moved, "file_id", "left_anti"), lib.closed, closed, delta, "file_id", touched=touched)
    again = _difference(lib.wide.join(moved, "file_id", "left_semi"), graph.propagate(now.join(moved, "file_id", "left_semi"), closed, "file_id"))
    wide_delta = graph.Delta(by_closure.added.unionByName(again.added), by_closure.removed.unionByName(again.removed))
    return _with_state(_with_wide(replace(lib, tags=after, closed=closed), wide_delta), lib.tags)


def _touched(lib: Library, after: TagTables, edges: graph.Delta) -> DataFrame | None:
    """Files (file_id) with a tag that may have other ancestors after a change; None where too many tags were changed to ask for them.

    A path over an edge that came or went starts at or below the lower end of such an edge, so these files had the lower end of
    one among their tags with ancestors. A tag that came or went, or that an edge names for the first time, changes for who has it itself.
    """
    ids = lambda rows, column="tag_id": rows.select(F.col(column).alias("tag_id"))
    came, went = ids(after.tags).join(ids(lib.tags.tags), "tag_id", "left_anti"), ids(lib.tags.tags).join(ids(after.tags), "tag_id", "left_anti")
    low = cut(union([ids(edges.added, "child"), ids(edges.removed, "child")]).distinct())
    named = cut(union([low, ids(edges.added, "parent"), came, went]).distinct())
    if named.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return None
    asked = [(part, low) for part in lib.parts] + [(lib.tags.file_tags, named)]
    return cut(union([pairs.join(F.broadcast(names), "tag_id", "left_semi").select("file_id") for pairs, names in asked]).distinct())


def _difference(was: DataFrame, now: DataFrame) -> graph.Delta:
    """What came and went between two sets of (file_id, tag_id), of files that are not null. A file's tags meet as lists, where the file lies."""
    a, b = (pairs.groupBy("file_id").agg(F.collect_set("tag_id").alias(name)) for pairs, name in ((was, "_was"), (now, "_now")))
    lists = [F.coalesce(c, F.array().cast("array<string>")) for c in ("_was", "_now")]
    came = F.transform(F.array_except(lists[1], lists[0]), lambda t: F.struct(t.alias("tag_id"), F.lit(True).alias("came")))
    went = F.transform(F.array_except(lists[0], lists[1]), lambda t: F.struct(t.alias("tag_id"), F.lit(False).alias("came")))
    both = cut(a.join(b, "file_id", "full").select("file_id", F.explode(F.concat(came, went)).alias("_x")).select("file_id", "_x.tag_id", "_x.came"))
    return graph.Delta(both.where("came").select(*PAIR), both.where("not came").select(*PAIR))


def _with_state(out: Library, was: TagTables) -> Library:
    """A row of counts for each tag there is now, and none for those of was that are gone."""
    gone = was.tags.select("tag_id").join(out.tags.tags.select("tag_id"), "tag_id", "left_anti")
    fresh = out.tags.tags.select("tag_id").join(out.tag_state.select("tag_id"), "tag_id", "left_anti")
    empty = fresh.select("tag_id", F.lit(0).cast("long").alias("n_files"), F.lit(0).cast("long").alias("total_size"), F.lit(None).cast(dict(out.tag_state.dtypes)["oldest"]).alias("oldest"))
    return replace(out, tag_state=out.tag_state.join(gone, "tag_id", "left_anti").unionByName(empty))


def _with_wide(lib: Library, delta: graph.Delta) -> Library:
    """With the pairs of delta put on and taken off; where the parts have become many, they and the own tags are written as one table each."""
    parts = [left for part in lib.parts for left in graph.without(part, delta.removed)] + [delta.added.select(*PAIR)]
    tags = lib.tags
    if len(parts) > PARTS:
        parts, tags = [bucketed(union(parts), "file_id")], replace(tags, file_tags=bucketed(tags.file_tags, "file_id"))
    return replace(lib, tags=tags, parts=tuple(parts), tag_state=rollups.rolled(lib.tag_state, delta, lib.files, lib.files, tuple(parts)))


def changed(before: DataFrame, after: DataFrame, owner: str, tag: str = "tag_id") -> DataFrame:
    """Owners whose sets of tags differ between two frames of (owner, tag)."""
    a, b = before.select(owner, tag).distinct(), after.select(owner, tag).distinct()
    return a.join(b, [owner, tag], "left_anti").select(owner).union(b.join(a, [owner, tag], "left_anti").select(owner)).distinct()


def closure_changed(members: DataFrame, before: DataFrame, after: DataFrame, owner: str, tag: str = "tag_id") -> DataFrame:
    """Owners whose tags with all ancestors differ under two closures; only those with a tag whose pairs differ are looked at."""
    names = ["tag", "ancestor"]
    a, b = before.select(*names), after.select(*names)
    delta = graph.held_delta(members, a, b, graph.Delta(b.join(a, names, "left_anti"), a.join(b, names, "left_anti")), owner, tag)
    return delta.added.select(owner).union(delta.removed.select(owner)).distinct()


def _put(rows: DataFrame, tag_ids: list) -> DataFrame:
    return rows.withColumn("tag_id", F.explode(F.array(*map(F.lit, tag_ids)).cast("array<string>")))


def retagged(file_tags: DataFrame, files: DataFrame, added: list, removed: list) -> DataFrame:
    """file_tags after tags are put on and then taken off some files (file_id); rows are dealt once, no pair is joined."""
    chosen, pairs = files.select("file_id").distinct(), ["file_id", "tag_id"]
    both = file_tags.select(*pairs).unionByName(_put(chosen, added)).withColumn("_off", F.lit(False))
    off = _put(chosen.where("file_id is not null"), removed).withColumn("_off", F.lit(True))
    return dealt(both.unionByName(off), *pairs).groupBy(*pairs).agg(F.bool_or("_off").alias("_off")).where("not _off").select(*pairs)


def retagged_batch(batch_tags: DataFrame, batch_id, added: list, removed: list) -> DataFrame:
    """batch_tags after the same change of one batch."""
    kept = batch_tags.select("batch_id", "tag_id").where((F.col("batch_id") != batch_id) | ~F.col("tag_id").isin(*removed))
    own = batch_tags.select("batch_id").where(F.col("batch_id") == batch_id).distinct()
    return kept.unionByName(_put(own, [t for t in added if t not in removed])).distinct()
