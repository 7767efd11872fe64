"""Imports: the status each file ends with, and batches built from folders."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators.collections import first_occurrence, reindexed
from corvane.operators.graph import lined
from corvane.operators.joins import known_hashes, tags_by_pattern
from corvane.session import cut, dealt, probed


def statuses(rows: DataFrame, files: DataFrame, tombstones: DataFrame, ignore_deleted: bool | Column = True) -> DataFrame:
    """rows (batch_id, pos, hash, error flag) with result: ERROR, DUPLICATE, DELETED or COMPLETE.

    A file that failed or could not be hashed (null) is an error. A stored hash is a duplicate, then one deleted before is
    refused where the batch says so; of equal hashes to be imported the first by batch and place is complete and the others
    are duplicates.
    """
    refuse = ignore_deleted if isinstance(ignore_deleted, Column) else F.lit(ignore_deleted)
    marked = known_hashes(rows, files, tombstones)
    failed = F.coalesce(F.col("failed"), F.lit(False)) if "failed" in rows.columns else F.lit(False)
    early = F.when(failed | F.col("hash").isNull(), "ERROR").when(F.col("is_duplicate"), "DUPLICATE").when(F.col("is_deleted") & refuse, "DELETED")
    marked = marked.withColumn("_early", early)
    # The first file of each hash, by an aggregate that adds up before the shuffle; no hash, however common, is one task's window.
    place = F.struct("batch_id", "pos")
    firsts = marked.where("_early is null").groupBy("hash").agg(F.min(place).alias("_first"))
    firsts = firsts.select(F.col("_first.batch_id").alias("batch_id"), F.col("_first.pos").alias("pos"), F.lit(True).alias("_is_first"))
    out = marked.join(firsts, ["batch_id", "pos"], "left")
    return out.withColumn("result", F.coalesce("_early", F.when(F.col("_is_first"), "COMPLETE").otherwise("DUPLICATE"))).select(*rows.columns, "is_duplicate", "is_deleted", "result")


def folder_tags(
    folders: DataFrame, root_index: int = 0, mode: str = "hierarchical", collection: str = "withTag", flatten_to: int | None = None, delimiter: str | None = None, decode: bool = False, title_as_tag: bool = True
) -> DataFrame:
    """(folder, label, parent_label, depth, collection_title) from folder paths.

    mode: none, cascading (flat tags) or hierarchical (each part under the one before). collection: none, withTag (the
    last part names a collection and is a tag too) or withoutTag. decode reads character references in the parts. With a
    delimiter a part may name several tags, each under each of those before. Without title_as_tag no label is the title.
    """
    parts = F.filter(F.split("folder", "/"), lambda p: p != "")
    if decode:
        parts = F.slice(parts, root_index + 1, flatten_to if flatten_to else 1 << 20)
        # Character references are read part by part, on each part once.
        each = dealt(folders.select("folder"), "folder").distinct().select("folder", F.posexplode_outer(parts).alias("_at", "_part")).withColumn("_part", text.decode_entities(F.col("_part")))
        rows = each.groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("_at", "_part"))).alias("_parts"))
        rows = rows.withColumn("_parts", F.array_distinct(F.filter(F.transform("_parts", lambda p: p["_part"]), lambda p: p.isNotNull())))
    else:
        parts = F.slice(F.array_distinct(parts), root_index + 1, flatten_to if flatten_to else 1 << 20)
        rows = folders.select("folder").distinct().withColumn("_parts", parts)
    title = F.lit(None).cast("string") if collection == "none" else F.when(F.size("_parts") > 0, F.element_at("_parts", -1))
    rows = rows.withColumn("collection_title", title)
    if collection == "withoutTag" or (mode == "cascading" and collection != "none"):
        rows = rows.withColumn("_parts", F.slice("_parts", 1, F.greatest(F.size("_parts") - 1, F.lit(0))))
    if mode == "none":
        rows = rows.withColumn("_parts", F.array().cast("array<string>"))
    out = rows.select("folder", "collection_title", F.posexplode_outer("_parts").alias("depth", "label"), "_parts")
    parent = F.when(F.col("depth") > 0, F.get("_parts", F.col("depth") - 1)) if mode == "hierarchical" else F.lit(None).cast("string")
    out = out.select("folder", "label", parent.alias("parent_label"), "depth", "collection_title")
    if delimiter:
        pieces = lambda c: F.filter(F.transform(F.split(c, re.escape(delimiter)), lambda x: F.trim(x)), lambda x: x != "")
        out = out.withColumn("label", F.explode_outer(pieces("label"))).withColumn("parent_label", F.explode_outer(pieces("parent_label")))
    return out if title_as_tag else out.where(F.coalesce(F.col("label") != F.col("collection_title"), F.lit(True)))


def planned_tags(found: DataFrame, parts: DataFrame, tags: DataFrame, patterns: DataFrame, closed: DataFrame) -> DataFrame:
    """(folder, label, parent_label): what tags a scan gives each folder, from the labels found (folder, label, parent_label).

    parts (folder, name) are the names whose matching tags are put in, of folders and of their collections. Of labels
    whose tag is an ancestor of another one's in the folder only the lower stay. Last, a label that patterns (tag_id, pattern)
    match is replaced by those tags' labels, but for one that is among its parents, and parents that they match get those tags'
    labels beside them. Names meet the patterns once, however many folders they stand in.
    """
    labels = tags.groupBy("tag_id").agg(F.min("label").alias("_new"))
    by_label = tags.groupBy("label").agg(F.min("tag_id").alias("tag_id"))
    asked = found.select(F.explode(F.array("label", "parent_label")).alias("name")).union(parts.select("name")).where("name is not null").distinct()
    hits = cut(tags_by_pattern(asked, patterns).join(labels, "tag_id").select("name", F.col("_new").alias("_match")).distinct())
    # Rows are dealt by what they meet on into small tasks, as their strings are much larger than they lie in a shuffle; names, matches and tags are the hashed side, so that a name in all folders is sorted nowhere.
    own = dealt(found.where("label is not null").select("folder", "label", "parent_label"), "folder", "label").distinct()
    more = dealt(parts.join(probed(hits), "name").select("folder", F.col("_match").alias("label")), "folder", "label").distinct().join(own.select("folder", "label"), ["folder", "label"], "left_anti")
    every = cut(own.unionByName(more.withColumn("parent_label", F.lit(None).cast("string"))))
    known = cut(dealt(every.select("folder", "label"), "folder", "label").distinct().join(probed(by_label), "label"))
    low = lined(known.select("folder", "tag_id"), closed.select("tag", "ancestor").where("tag <> ancestor"), "folder").select("folder", F.explode("_line").alias("tag_id")).distinct()
    covered = dealt(known, "folder", "tag_id").join(dealt(low, "folder", "tag_id"), ["folder", "tag_id"], "left_semi").select("folder", "label")
    left = cut(dealt(every, "folder", "label").join(dealt(covered, "folder", "label"), ["folder", "label"], "left_anti"))
    above = left.where("parent_label is not null").select("folder", F.col("label").alias("_of"), F.col("parent_label").alias("_match")).distinct()
    matches = probed(hits)
    changed = left.join(matches.withColumnRenamed("name", "label"), "label", "left").withColumn("_hit", F.col("_match").isNotNull()).withColumn("_of", F.col("label"))
    kept = changed.where("not _hit").unionByName(dealt(changed.where("_hit"), "folder", "_of", "_match").join(dealt(above, "folder", "_of", "_match"), ["folder", "_of", "_match"], "left_anti"), allowMissingColumns=True)
    named = kept.select("folder", F.coalesce("_match", "label").alias("label"), "parent_label")
    wider = named.join(matches.select(F.col("name").alias("parent_label"), F.col("_match").alias("_up")), "parent_label").where("_up <> label").select("folder", "label", F.col("_up").alias("parent_label"))
    return dealt(named.unionByName(wider), "folder", "label").distinct()


def effective_tags(rows: DataFrame, batch_tags: DataFrame, file_tags: DataFrame) -> DataFrame:
    """(batch_id, pos, tag_id): tags of the file and of its batch, once each."""
    own = rows.select("batch_id", "pos").join(probed(batch_tags), "batch_id").select("batch_id", "pos", "tag_id")
    return dealt(own.unionByName(file_tags.select("batch_id", "pos", "tag_id")), "batch_id").distinct()


def completed_batches(batches: DataFrame, imports: DataFrame, batch_tags: DataFrame, file_tags: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(batches, collections, members, file_tags) after batches with nothing pending are closed.

    imports: (batch_id, pos, file_id, status). A batch with a title becomes a collection of its complete and duplicate
    files in order, each once, with an id made from the batch's; its tags go to the files that were there before.
    """
    pending = imports.where("status = 'PENDING'").select("batch_id").distinct().withColumn("_pending", F.lit(True))
    settled = batches.where("not is_completed").join(pending, "batch_id", "left").where("_pending is null").select("batch_id", "collection_title")
    own = imports.join(settled, "batch_id").where("file_id is not null and status in ('COMPLETE', 'DUPLICATE')")
    titled = own.where("coalesce(collection_title, '') <> ''")
    collection = F.concat(F.lit("C"), F.col("batch_id").cast("string"))
    members = reindexed(first_occurrence(titled.select(collection.alias("collection_id"), "file_id", F.col("pos").alias("idx"))))
    collections = titled.groupBy("batch_id", "collection_title").agg(F.count_distinct("file_id").alias("n_files")).select(collection.alias("collection_id"), F.col("collection_title").alias("title"), "n_files")
    repeats = own.where("status = 'DUPLICATE'").select("batch_id", "file_id").join(batch_tags, "batch_id").select("file_id", "tag_id")
    made = collections.select(F.expr("substring(collection_id, 2)").cast(dict(batches.dtypes)["batch_id"]).alias("batch_id"), "collection_id")
    done = batches.join(settled.select("batch_id").withColumn("_done", F.lit(True)), "batch_id", "left").join(made, "batch_id", "left")
    out = done.withColumns({"is_completed": F.col("is_completed") | F.coalesce("_done", F.lit(False)), "completed_at": F.when(F.col("_done"), now).otherwise(F.col("completed_at"))})
    return out.select(*batches.columns, "collection_id"), collections, members, file_tags.select("file_id", "tag_id").unionByName(repeats).distinct()


def reingested(file_tags: DataFrame, found: DataFrame, collection_id=None) -> tuple[DataFrame, DataFrame | None]:
    """(file_tags, members) after a folder is read again: found (file_id, pos, tag_ids) adds tags and, with an id, makes a collection in that order."""
    more = found.select("file_id", F.explode("tag_ids").alias("tag_id"))
    members = reindexed(first_occurrence(found.select(F.lit(collection_id).alias("collection_id"), "file_id", F.col("pos").alias("idx")))) if collection_id is not None else None
    return file_tags.select("file_id", "tag_id").unionByName(more).distinct(), members


def next_batch(batches: DataFrame) -> DataFrame:
    """The one to run: started ones first, the latest of them, then the oldest."""
    return batches.where("not is_completed").orderBy(F.col("started_at").desc_nulls_last(), F.col("date_created").asc_nulls_first(), "batch_id").limit(1)
