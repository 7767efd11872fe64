"""Folders as tables, side files, and files written from tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corvane.functions.text import extension
from corvane.operators.joins import basename
from corvane.session import cut


def listing(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """One row per file below folder with one of the extensions: path, name, extension, size, date_created, status; no content is read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    out = rows.select("path", basename(F.col("path")).alias("name"), F.lower(extension(F.col("path"))).alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("date_created"))
    return out.where(F.col("extension").isin(*(e.lower() for e in extensions))).withColumn("status", F.lit("PENDING"))


def hashed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, hash): MD5 of each file's bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.md5("content").alias("hash"))


def stem(path):
    return F.regexp_replace(path, r"\.\w+$", "")


def with_text_sidecars(rows: DataFrame, folder: str) -> DataFrame:
    """rows with side_text, the .txt file of the same name."""
    texts = rows.sparkSession.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(folder)
    texts = texts.select(stem(F.col("_metadata.file_path")).alias("_stem"), F.col("value").alias("side_text"))
    return rows.withColumn("_stem", stem(F.col("path"))).join(texts, "_stem", "left").drop("_stem")


def with_json_sidecars(rows: DataFrame, folder: str) -> DataFrame:
    """rows with side_tags, the labels of <file>.json beside each file."""
    schema = "tags array<struct<label:string,aliases:array<string>,parentLabels:array<string>>>"
    notes = rows.sparkSession.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder)
    notes = notes.select(F.regexp_replace(F.col("_metadata.file_path"), r"\.json$", "").alias("_of"), F.transform("tags", lambda t: t["label"]).alias("side_tags"))
    return rows.join(notes, rows["path"] == notes["_of"], "left").drop("_of")


def with_folder_sidecars(rows: DataFrame, folder: str, name: str = "[[Collection]].json") -> DataFrame:
    """rows with folder_tags, the labels of the one side file that stands for the whole folder."""
    schema = "tags array<struct<label:string,aliases:array<string>,parentLabels:array<string>>>"
    notes = rows.sparkSession.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder)
    notes = notes.select(F.url_decode(F.col("_metadata.file_path")).alias("_file"), F.transform("tags", lambda t: t["label"]).alias("folder_tags")).where(basename(F.col("_file")) == name)
    notes = notes.select(F.regexp_replace("_file", r"/[^/]*$", "").alias("_folder"), "folder_tags")
    return rows.withColumn("_of", F.regexp_replace("path", r"/[^/]*$", "")).join(notes, F.col("_of") == F.col("_folder"), "left").drop("_of", "_folder")


def storage_path(folder, content_hash, ext):
    """folder/ab/cd/abcd....ext"""
    return F.concat_ws("/", folder, F.substring(content_hash, 1, 2), F.substring(content_hash, 3, 2), F.concat(content_hash, F.lit("."), ext))


#: Ranges that one task goes through at a time where places are nearly full.
EXACT_RANGES = 16


def choose_storage(rows: DataFrame, places: list[tuple[str, int]], ranges: int | None = None) -> DataFrame:
    """rows (key, size) in the order of their keys, each with the first place whose free bytes are more than its size; null where none has.

    What a file takes is gone for those after it, so the rooms that a range of keys finds decide what it leaves. Where the
    first place with room for the least file of a range has more than the whole range needs, the range takes its sum; only
    ranges where a place fills up, or is left with room for small files, are gone through row by row to know what they leave. With
    the rooms at its start known, each range then assigns its own rows. Rows without a size get no place; rows of one key
    are taken in any order.
    """
    spark = rows.sparkSession
    width = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(rows.repartitionByRange(width, "key").withColumn("_range", F.spark_partition_id()))
    sums = ranged.where("size is not null").groupBy("_range").agg(F.sum("size").cast("long").alias("sum"), F.min("size").cast("long").alias("least"))
    found = {r["_range"]: (r["sum"], r["least"]) for r in sums.collect()}  # a row a range
    rooms, starts, at, order = [free for _, free in places], {}, 0, sorted(found)
    while at < len(order):
        total, least = found[order[at]]
        first = next((k for k, free in enumerate(rooms) if free > least), None)
        if first is None or rooms[first] > total:
            starts[order[at]] = list(rooms)
            if first is not None:
                rooms[first] -= total
            at += 1
            continue
        some = order[at : at + EXACT_RANGES]
        for number, before, after in _rooms_left(ranged.where(F.col("_range").isin(some)), rooms):
            starts[number], rooms = list(before), list(after)
        at += len(some)
    known = spark.createDataFrame([(k, v) for k, v in starts.items()], "_range int, _rooms array<long>")
    out = ranged.join(F.broadcast(known), "_range", "left")
    schema = StructType([*rows.schema.fields, StructField("storage", StringType())])

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        free = list(pdf["_rooms"].iloc[0]) if pdf["_rooms"].iloc[0] is not None else []
        chosen = [_take(free, size) for size in pdf["size"]]
        return pdf.drop(columns=["_range", "_rooms"]).assign(storage=[None if k is None else places[k][0] for k in chosen])

    return out.groupBy("_range").applyInPandas(assign, schema)


def _take(free: list[int], size) -> int | None:
    """The first place with more room than size, which is taken from it."""
    if size is None or size != size:
        return None
    k = next((k for k, room in enumerate(free) if room > size), None)
    if k is not None:
        free[k] -= int(size)
    return k


def _rooms_left(rows: DataFrame, rooms: list[int]) -> list[tuple[int, list[int], list[int]]]:
    """(range, rooms before, rooms after) of some ranges that follow each other, gone through in one task that holds a batch of rows."""

    def run(frames):
        free, number, before = list(rooms), None, None
        for pdf in frames:
            for own, size in zip(pdf["_range"], pdf["size"]):
                if own != number:
                    if number is not None:
                        yield pd.DataFrame({"_range": [number], "before": [before], "after": [list(free)]})
                    number, before = own, list(free)
                _take(free, size)
        if number is not None:
            yield pd.DataFrame({"_range": [number], "before": [before], "after": [list(free)]})

    sizes = rows.where("size is not null").select("_range", "key", "size").repartitionByRange(1, "_range", "key").sortWithinPartitions("_range", "key").select("_range", F.col("size").cast("long").alias("size"))
    got = sizes.mapInPandas(run, "_range int, before array<long>, after array<long>").collect()  # a row a range
    return sorted((r["_range"], r["before"], r["after"]) for r in got)


def playlist(files: DataFrame, ids: list, active: int = 0, end: int = 100) -> DataFrame:
    """(position, line): paths in the order of ids from the active one, up to place `end` of the list."""
    part = ids[active:end]
    wanted = files.sparkSession.createDataFrame([(i, k) for k, i in enumerate(part)], f"_id {dict(files.dtypes)['file_id']}, position int")
    return files.join(F.broadcast(wanted), files["file_id"] == wanted["_id"]).select("position", F.col("path").alias("line")).orderBy("position")
