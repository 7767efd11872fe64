"""Counts, sums and means that are kept beside tags, collections and imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import graph
from corvane.session import BROADCAST_ROWS, cut, probed, union


def tag_rollup(tags: DataFrame, file_tags: DataFrame, files: DataFrame, once: bool = False) -> DataFrame:
    """For every tag: files that hold it or a descendant, their bytes, and the file whose picture stands for it (the oldest).

    file_tags: (file_id, tag_id) with ancestors; once: no pair stands there twice, as after propagate(). Tags without files get 0, 0 and null.
    """
    pairs = file_tags.select("file_id", "tag_id")
    # A left join leaves the pairs as they are, so that their shuffle serves others too; pairs of no file count nothing.
    held = (pairs if once else pairs.distinct()).join(files.select("file_id", "size", "date_created", F.lit(True).alias("_known")), "file_id", "left")
    sums = held.groupBy("tag_id").agg(F.count("_known").alias("n_files"), F.sum("size").alias("total_size"), F.min(F.when(F.col("_known"), F.struct("date_created", "file_id"))).alias("first"))
    out = tags.select("tag_id").join(sums, "tag_id", "left")
    return out.select("tag_id", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("total_size", F.lit(0)).alias("total_size"), F.col("first.file_id").alias("thumb_file"))


#: Oldest files that are kept for each tag, so that the picture of a tag survives most deletions without a search.
RUNNERS = 8


def _oldest(held: DataFrame, most: int) -> DataFrame:
    """(tag_id, date_created, file_id): the `most` oldest files of each tag; each task passes on so many at most."""
    order = Window.partitionBy("tag_id").orderBy("date_created", "file_id")
    return held.select("tag_id", "date_created", "file_id").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def _listed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tag_id").agg(F.array_sort(F.collect_list(F.struct("date_created", "file_id"))).alias("oldest"))


def rollup_state(tags: DataFrame, wide: DataFrame, files: DataFrame, runners: int = RUNNERS) -> DataFrame:
    """(tag_id, n_files, total_size, oldest): tag_rollup() in a form that rolled() keeps up to date. wide: (file_id, tag_id) with ancestors, once each."""
    held = wide.select("file_id", "tag_id").join(files.select("file_id", "size", "date_created").hint("shuffle_hash"), "file_id")
    sums = held.groupBy("tag_id").agg(F.count("*").alias("n_files"), F.sum("size").alias("total_size"))
    out = tags.select("tag_id").distinct().join(sums, "tag_id", "left").join(_listed(_oldest(held, runners)), "tag_id", "left")
    return out.select("tag_id", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("total_size", F.lit(0)).alias("total_size"), "oldest")


def rolled(state: DataFrame, delta: graph.Delta, files_before: DataFrame, files_after: DataFrame, wide_after: DataFrame | tuple[DataFrame, ...], runners: int = RUNNERS) -> DataFrame:
    """rollup_state() after (file_id, tag_id) pairs came and went.

    Counts and bytes change by what came less what went. The list of oldest files loses those that went and takes in new ones
    that are older than its last, as others may be missing from it beyond that; a list that holds all files of its tag takes in
    any. What a list may lose or take in is among the oldest pairs of its tag that went or came, so that these meet the state by tag,
    and where few tags are concerned the state does not move. Only a tag whose list runs empty while it still has files is looked up
    in wide_after, a frame or the parts of one. A file whose size or date changes went with its old values and came with the new; pairs
    that carry size and date_created are not looked up in the files. Tags that only the delta names get a row.
    """
    facts = ["size", "date_created"]
    of = lambda pairs, files: (pairs if set(facts) <= set(pairs.columns) else pairs.join(files.select("file_id", *facts).hint("shuffle_hash"), "file_id")).select("file_id", "tag_id", *facts)
    came, went = of(delta.added, files_after), of(delta.removed, files_before)
    signed = came.withColumn("_sign", F.lit(1)).unionByName(went.withColumn("_sign", F.lit(-1)))
    sums = signed.groupBy("tag_id").agg(F.sum("_sign").alias("_n"), F.sum(F.col("size") * F.col("_sign")).alias("_size"))
    most = max(runners, state.agg(F.max(F.size("oldest"))).first()[0] or 0)
    new, lost = (_listed(_oldest(pairs, n)).withColumnRenamed("oldest", name) for pairs, n, name in ((came, runners, "_came"), (went, most, "_went")))
    changes = cut(sums.join(new, "tag_id", "left").join(lost, "tag_id", "left"))
    if changes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = F.broadcast(cut(state.join(F.broadcast(changes.select("tag_id")), "tag_id", "left_semi").select("tag_id")))
        fresh = changes.join(known, "tag_id", "left_anti")
        both = state.join(F.broadcast(changes), "tag_id", "left").unionByName(fresh, allowMissingColumns=True)
    else:
        both = state.join(changes, "tag_id", "full")
    listed = F.coalesce("oldest", F.array().cast(dict(state.dtypes)["oldest"]))
    last = F.when(F.size(listed) < F.coalesce("n_files", F.lit(0)), F.element_at("oldest", -1))
    left = F.filter(listed, lambda x: ~F.coalesce(F.array_contains(F.col("_went.file_id"), x["file_id"]), F.lit(False)))
    fits = F.filter(F.coalesce("_came", F.array().cast(dict(state.dtypes)["oldest"])), lambda x: last.isNull() | (x <= last))
    merged = F.slice(F.array_sort(F.concat(left, fits)), 1, runners)
    out = cut(both.select(
        "tag_id", (F.coalesce("n_files", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n_files"), (F.coalesce("total_size", F.lit(0)) + F.coalesce("_size", F.lit(0))).alias("total_size"),
        F.when(F.col("_n").isNull(), F.col("oldest")).when(F.size(merged) > 0, merged).alias("oldest"),
    ))
    empty = cut(out.where("n_files > 0 and oldest is null").select("tag_id"))
    if empty.isEmpty():
        return out
    asked = probed(empty)
    refill = union([of(part.join(asked, "tag_id", "left_semi"), files_after) for part in ([wide_after] if isinstance(wide_after, DataFrame) else wide_after)])
    found = probed(cut(_listed(_oldest(refill, runners)).withColumnRenamed("oldest", "_found")))
    return out.join(found, "tag_id", "left").select("tag_id", "n_files", "total_size", F.coalesce("oldest", "_found").alias("oldest"))


def rollup_of(state: DataFrame) -> DataFrame:
    """(tag_id, n_files, total_size, thumb_file) of rollup_state()."""
    return state.select("tag_id", "n_files", "total_size", F.get("oldest", F.lit(0))["file_id"].alias("thumb_file"))


def collection_state(members: DataFrame, files: DataFrame) -> DataFrame:
    """(collection_id, n_files, total_size, n_rated, rating_sum): the sums behind collection_rollup()."""
    held = members.select("collection_id", "file_id").join(files.select("file_id", "size", "rating"), "file_id").withColumn("_sign", F.lit(1))
    return _collection_sums(held)


def _collection_sums(held: DataFrame) -> DataFrame:
    rated = F.when(F.col("rating") > 0, F.col("_sign"))
    return held.groupBy("collection_id").agg(
        F.sum("_sign").alias("n_files"), F.sum(F.col("size") * F.col("_sign")).alias("total_size"), F.coalesce(F.sum(rated), F.lit(0)).alias("n_rated"),
        F.coalesce(F.sum(rated * F.col("rating")), F.lit(0)).cast("double").alias("rating_sum"),
    )


def collections_rolled(state: DataFrame, delta: graph.Delta, files_before: DataFrame, files_after: DataFrame) -> DataFrame:
    """collection_state() after (collection_id, file_id) members came and went; collections left without files go."""
    of = lambda pairs, files, sign: pairs.select("collection_id", "file_id").join(files.select("file_id", "size", "rating"), "file_id").withColumn("_sign", F.lit(sign))
    sums = _collection_sums(of(delta.added, files_after, 1).unionByName(of(delta.removed, files_before, -1)))
    names = ("n_files", "total_size", "n_rated", "rating_sum")
    both = state.unionByName(sums).groupBy("collection_id").agg(*(F.sum(c).alias(c) for c in names))
    return both.where("n_files > 0")


def collection_rollup_of(state: DataFrame) -> DataFrame:
    """(collection_id, n_files, total_size, rating) of collection_state()."""
    return state.select("collection_id", "n_files", "total_size", F.when(F.col("n_rated") > 0, F.col("rating_sum") / F.col("n_rated")).otherwise(0.0).alias("rating"))


def mean_rating(rating: Column) -> Column:
    """Mean of the rated ones (over 0), else 0."""
    return F.coalesce(F.avg(F.when(rating > 0, rating)), F.lit(0.0))


def collection_rollup(members: DataFrame, files: DataFrame, file_tags: DataFrame | None = None) -> DataFrame:
    """For every collection: files, bytes, mean rating; with file_tags also how many distinct tags its files hold."""
    held = members.select("collection_id", "file_id").join(files.select("file_id", "size", "rating"), "file_id")
    out = held.groupBy("collection_id").agg(F.count("*").alias("n_files"), F.sum("size").alias("total_size"), mean_rating(F.col("rating")).alias("rating"))
    if file_tags is not None:
        tags = members.select("collection_id", "file_id").join(file_tags, "file_id").select("collection_id", "tag_id").distinct().groupBy("collection_id").agg(F.count("*").alias("n_tags"))
        out = out.join(tags, "collection_id", "left").withColumn("n_tags", F.coalesce("n_tags", F.lit(0)))
    return out


def collection_tags(members: DataFrame, file_tags: DataFrame, closed: DataFrame) -> DataFrame:
    """(collection_id, tag_ids, tag_ids_with_ancestors): the tags of a collection's files by first appearance, and all above them, sorted."""
    held = members.select("collection_id", "file_id", "idx").join(file_tags, "file_id").select("collection_id", "tag_id", "idx")
    # Rows move to their collection once, and both lists are made there.
    first = graph.lined(held, closed, "collection_id").groupBy("collection_id", "tag_id").agg(F.min("idx").alias("idx"), F.first("_line").alias("_line"))
    lists = first.groupBy("collection_id").agg(F.array_sort(F.collect_list(F.struct("idx", "tag_id"))).alias("_own"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_line")))).alias("_wide"))
    return lists.select("collection_id", F.transform("_own", lambda x: x["tag_id"]).alias("tag_ids"), F.when(F.size("_wide") > 0, F.col("_wide")).alias("tag_ids_with_ancestors"))


def rating_after_edit(update_manual: Column, update_rating: Column, was_manual: Column, was_rating: Column, derived: Column) -> Column:
    """A rating set by hand wins, then one set by hand before, then the derived one."""
    return F.when(F.coalesce(update_manual, F.lit(False)), F.coalesce(update_rating, was_rating)).when(F.coalesce(was_manual, F.lit(False)), was_rating).otherwise(derived)


def duplicate_labels(tags: DataFrame) -> DataFrame:
    """Labels that several tags have but for case: key, how many, and the tag that survives (highest count, then least id)."""
    best = F.min(F.struct((-F.col("count")).alias("c"), "tag_id"))["tag_id"]
    return tags.groupBy(F.lower("label").alias("key")).agg(F.count("*").alias("n_tags"), best.alias("survivor")).where("n_tags > 1")


def duplicate_groups(tags: DataFrame) -> DataFrame:
    """The tags whose label, case aside, several have: all their columns with key and how many there are."""
    several = tags.groupBy(F.lower("label").alias("key")).agg(F.count("*").alias("n_tags")).where("n_tags > 1")
    return tags.join(several, F.lower(tags["label"]) == several["key"])


def merge_plan(tags: DataFrame) -> DataFrame:
    """(gone, kept) for all duplicate labels."""
    w = Window.partitionBy(F.lower("label"))
    kept = F.min(F.struct((-F.col("count")).alias("c"), "tag_id")).over(w)["tag_id"]
    return tags.select(F.col("tag_id").alias("gone"), kept.alias("kept")).where("gone <> kept")


def selection_stats(files: DataFrame, is_video: Column) -> DataFrame:
    """Count and bytes of images and videos, and of both together."""
    kinds = files.select(F.when(is_video, "videos").otherwise("images").alias("kind"), "size").rollup("kind").agg(F.count("*").alias("n_files"), F.sum("size").alias("total_size"))
    return kinds.withColumn("kind", F.coalesce("kind", F.lit("total")))


def import_progress(rows: DataFrame) -> DataFrame:
    """For each batch: bytes done and in all, files completed (complete or duplicate) and imported (any but pending)."""
    done = F.col("status") != "PENDING"
    return rows.groupBy("batch_id").agg(
        F.sum(F.when(done, F.col("size")).otherwise(0)).alias("done_size"), F.sum("size").alias("total_size"), F.count("*").alias("n_files"),
        F.count_if(F.col("status").isin("COMPLETE", "DUPLICATE")).alias("n_completed"), F.count_if(done).alias("n_imported"),
    )


def fill_status(used: Column, total: Column, warn: float = 0.75, full: float = 0.9) -> Column:
    share = used / total
    return F.when(share >= full, "full").when(share >= warn, "warning").otherwise("ok")
