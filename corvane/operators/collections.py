"""Ordered collections: (collection_id, file_id, idx)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import dirname
from corvane.session import cut, dealt


def first_occurrence(members: DataFrame) -> DataFrame:
    """Of a file's several places in a collection, the first; rows without a file go."""
    w = Window.partitionBy("collection_id", "file_id").orderBy("idx")
    return members.where("file_id is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def reindexed(members: DataFrame) -> DataFrame:
    """Places from 0 without gaps, in the order of the old ones."""
    w = Window.partitionBy("collection_id").orderBy("idx", "file_id")
    return members.withColumn("idx", (F.row_number().over(w) - 1).cast("int"))


def cleaned(members: DataFrame) -> DataFrame:
    return reindexed(first_occurrence(members).select("collection_id", "file_id", "idx"))


def prepended(members: DataFrame, added: DataFrame) -> DataFrame:
    """New files stand first, in their order; files that are there already keep their place."""
    new = added.join(members.select("collection_id", "file_id"), ["collection_id", "file_id"], "left_anti").withColumn("_old", F.lit(0))
    both = new.select("collection_id", "file_id", "idx", "_old").unionByName(members.select("collection_id", "file_id", "idx", F.lit(1).alias("_old")))
    w = Window.partitionBy("collection_id").orderBy("_old", "idx", "file_id")
    return both.withColumn("idx", (F.row_number().over(w) - 1).cast("int")).drop("_old")


def in_order(members: DataFrame, descending: bool = False) -> DataFrame:
    """Members by their place in the collection."""
    return members.orderBy("collection_id", F.col("idx").desc() if descending else F.col("idx").asc(), "file_id")


def by_folder(paths: DataFrame) -> DataFrame:
    """(folder, first_pos, pos, path) from (pos, path): folders by first appearance, their paths in order."""
    rows = paths.withColumn("folder", dirname(F.col("path")))
    first = rows.groupBy("folder").agg(F.min("pos").alias("first_pos"))
    return rows.join(first, "folder").select("folder", "first_pos", "pos", "path").orderBy("first_pos", "pos")


def preview(members: DataFrame, most: int = 8) -> DataFrame:
    """The first files of each collection, as text; an ordered fold would hold whole collections, so only the first rows are gathered."""
    w = Window.partitionBy("collection_id").orderBy("idx")
    top = members.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    lists = top.groupBy("collection_id").agg(F.array_sort(F.collect_list(F.struct("_n", "file_id"))).alias("x"))
    return lists.select("collection_id", F.array_join(F.transform("x", lambda r: r["file_id"].cast("string")), ",").alias("file_ids"))


def sets_of(own: DataFrame) -> DataFrame:
    """(collection_id, n, a, b): size and two digests of the set of files, added up without gathering it; own: distinct members."""
    return own.groupBy("collection_id").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("file_id")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "file_id")).alias("b"))


def equal_sets(members: DataFrame) -> DataFrame:
    """(collection_id, kept): each collection and the least one with the same files. Sets of equal digests are compared file by file."""
    own = members.where("file_id is not null").select("collection_id", "file_id").distinct()
    sets = cut(sets_of(own))
    least = sets.groupBy("n", "a", "b").agg(F.min("collection_id").alias("kept"))
    pairs = sets.join(least, ["n", "a", "b"]).select("collection_id", "kept", "n")
    other = own.select(F.col("collection_id").alias("kept"), "file_id")
    same = pairs.where("collection_id <> kept").join(own, "collection_id").join(other, ["kept", "file_id"]).groupBy("collection_id", "kept", "n").agg(F.count("*").alias("c")).where("c = n")
    return sets.select("collection_id").join(same.select("collection_id", "kept"), "collection_id", "left").select("collection_id", F.coalesce("kept", "collection_id").alias("kept"))


def proper_subsets(members: DataFrame) -> DataFrame:
    """Collections (collection_id) whose files all stand in some larger one.

    An inverted index: a small collection meets larger ones only through its rarest file, so a file that is everywhere
    brings no pairs unless nothing rarer is there. Of one file that is proof; else the larger one's 64 bits of files must hold
    the small one's, which leaves few pairs whose files are all compared.
    """
    own = dealt(members.where("file_id is not null").select("collection_id", "file_id"), "collection_id").distinct()
    sizes = own.groupBy("collection_id").agg(F.count("*").alias("n"), F.expr("bit_or(shiftleft(1L, cast(pmod(xxhash64(file_id), 64) as int)))").alias("bits"))
    sized = own.join(sizes.hint("shuffle_hash"), "collection_id")
    often = sized.groupBy("file_id").agg(F.count("*").alias("f"), F.max("n").alias("most"))
    rarest = sized.join(often, "file_id").groupBy("collection_id", "n", "bits").agg(F.min(F.struct("f", "file_id", "most")).alias("x"))
    # Where the rarest file is in no larger collection, nothing holds this one.
    rare = cut(rarest.where("x.most > n").select("collection_id", "n", "bits", "x.file_id"))
    large = sized.select("file_id", F.col("collection_id").alias("large"), F.col("n").alias("n_large"), F.col("bits").alias("_bits"))
    pairs = rare.where("n > 1").join(large, "file_id").where("n < n_large and bits & ~_bits = 0").select(F.col("collection_id").alias("small"), "large", F.col("n").alias("n_small"))
    both = pairs.join(own.withColumnRenamed("collection_id", "small"), "small").join(own.withColumnRenamed("collection_id", "large"), ["large", "file_id"], "left_semi")
    whole = both.groupBy("small", "large", "n_small").agg(F.count("*").alias("c")).where("c = n_small").select(F.col("small").alias("collection_id")).distinct()
    return rare.where("n = 1").select("collection_id").unionByName(whole)


def repaired(members: DataFrame) -> DataFrame:
    """Equal sets once, no empty ones, places clean, no proper subsets."""
    kept = equal_sets(members).where("collection_id = kept").select("collection_id")
    clean = cut(cleaned(members.join(kept, "collection_id", "left_semi")))
    return clean.join(proper_subsets(clean), "collection_id", "left_anti")
