"""Sorted, paged and counted results, and selections in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.session import among

def ordered(df: DataFrame, key: str, descending: bool, id_col: str) -> DataFrame:
    """A total order: key, then id, in the same direction; nulls first ascending, last descending."""
    return df.orderBy(*(F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in (key, id_col)))


def page(df: DataFrame, key: str, descending: bool, number: int, size: int, id_col: str) -> DataFrame:
    return ordered(df, key, descending, id_col).offset(max(0, number - 1) * size).limit(size)


def by_ids(df: DataFrame, ids: list, id_col: str, number: int | None = None, size: int | None = None) -> DataFrame:
    """The rows of these ids in the order of the list, with their place from 0 in column position; other filters don't count."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(i, k) for k, i in enumerate(dict.fromkeys(ids))], f"_id {dict(df.dtypes)[id_col]}, position int")
    rows = among(df, id_col, ids)
    out = rows.join(F.broadcast(wanted) if len(ids) <= 1_000_000 else wanted, rows[id_col] == wanted["_id"]).drop("_id").orderBy("position")
    return out.offset(max(0, number - 1) * size).limit(size) if number and size else out


def count_full(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_pages", F.ceil(F.col("n_rows") / size).cast("long"))


def count_capped(df: DataFrame, size: int, number: int, current_most: int, ahead: int = 1_000) -> DataFrame:
    """Counts no further than the furthest page that can be asked for next."""
    most = current_most + ahead if number >= current_most else current_most
    return count_full(df.limit(most * size), size)


def neighbours(df: DataFrame, key: str, descending: bool, number: int, size: int, id_col: str, each_side: int = 250) -> DataFrame:
    """Ids around a page: from each_side before its start, 2 * each_side + 1 of them."""
    return ordered(df, key, descending, id_col).select(key, id_col).offset(max(0, (number - 1) * size - each_side)).limit(2 * each_side + 1).select(id_col)


def before(key: str, id_col: str, mark: tuple, descending: bool = False) -> Column:
    """Whether a row stands before (key value, id) in the order of ordered()."""
    value, own = mark
    k, i = F.col(key), F.col(id_col)
    if descending:
        if value is None:
            return k.isNotNull() | (i > own)
        return F.coalesce((k > F.lit(value)) | ((k == F.lit(value)) & (i > own)), F.lit(False))
    if value is None:
        return k.isNull() & (i < own)
    return k.isNull() | (k < F.lit(value)) | ((k == F.lit(value)) & (i < own))


def ranks(df: DataFrame, key: str, id_col: str, ids: list, descending: bool = False) -> DataFrame:
    """Rank from 0 of each of a few rows: how many stand before it, counted in one pass without sorting. Many ranks: places.order_index()."""
    marks = [(r[key], r[id_col]) for r in among(df, id_col, ids).select(key, id_col).collect()]  # one row per asked id
    if not marks:
        return df.select(id_col, F.lit(0).cast("long").alias("rank")).limit(0)
    counts = df.agg(*(F.count_if(before(key, id_col, m, descending)).alias(f"r{i}") for i, m in enumerate(marks)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(m[1]).alias(id_col), F.col(f"r{i}").alias("rank")) for i, m in enumerate(marks)))).alias("x")).select("x.*")


def shift_select(df: DataFrame, key: str, id_col: str, clicked, selected: list, descending: bool = False) -> DataFrame:
    """(id, action): what a click with the shift key selects and deselects, in the order of (key, id).

    Boundaries are compared, not ranked, so nothing is sorted as a whole.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)[id_col]

    def rows(pairs: list[tuple]) -> DataFrame:
        return spark.createDataFrame(pairs, f"{id_col} {kind}, action string")

    if not selected:
        return rows([(clicked, "select")])
    if list(selected) == [clicked]:
        return rows([(clicked, "deselect")])
    place = F.struct(F.col(key).isNotNull().alias("filled"), F.col(key).alias("k"), F.col(id_col).alias("i"))
    ends = among(df, id_col, [*selected, clicked])
    chosen = F.col(id_col) != clicked if clicked not in selected else F.lit(True)
    ends = ends.agg(F.min(F.when(chosen, place)).alias("first"), F.max(F.when(chosen, place)).alias("last"), F.max(F.when(F.col(id_col) == clicked, place)).alias("clicked")).first()
    first, last, at = (tuple(ends[c]) if ends[c] else None for c in (("last", "first", "clicked") if descending else ("first", "last", "clicked")))
    if first is None or at is None:
        return rows([(clicked, "select")])
    if first == at:
        return rows([(clicked, "deselect")])
    later = before(key, id_col, (first[1], first[2]), descending)
    is_after = bool(df.where(F.col(id_col) == clicked).where(later).head(1))
    low, high = (at, last) if is_after else (first, at)
    inside = ~before(key, id_col, low[1:], descending) & (before(key, id_col, high[1:], descending) | (F.col(id_col) == high[2]))
    part = df.where(inside).select(id_col)
    wanted = spark.createDataFrame([(i,) for i in dict.fromkeys(selected)], f"{id_col} {kind}")
    return among(part, id_col, selected, keep=False).withColumn("action", F.lit("select")).unionByName(wanted.join(part, id_col, "left_anti").withColumn("action", F.lit("deselect")))


def with_tags(rows: DataFrame, row_tags: DataFrame, tags: DataFrame, id_col: str = "file_id") -> DataFrame:
    """rows with an array of (tag_id, label), by tag id; empty where there are none."""
    held = row_tags.join(rows.select(id_col), id_col, "left_semi").join(tags, "tag_id")
    lists = held.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("tag_id", "label"))).alias("tags"))
    return rows.join(lists, id_col, "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<struct<tag_id:string,label:string>>")))


def chip_order(tags: DataFrame) -> DataFrame:
    """Order of tag chips: new ones, sort rank, colour, icon, count; missing ranks last."""
    return tags.orderBy(F.desc("is_new"), F.col("sort_rank").desc_nulls_last(), F.col("color").isNotNull().desc(), F.col("color").desc_nulls_last(), F.col("icon").isNotNull().desc(), F.col("icon").desc_nulls_last(), F.desc("count"), "tag_id")


def tag_search(tags: DataFrame, query: str, included: list = (), excluded: list = (), most: int = 50) -> DataFrame:
    """Tags (tag_id, label, aliases, last_searched, count) with a score that hold every term of the query, the best ones.

    Order: score, searched last, count, id. All that match are scored before the cut.
    """
    q, label, aliases = query.strip(), F.col("label"), F.col("aliases")
    rows = tags.where((F.coalesce(label, F.lit("")) != "") & text.matches_all_terms(q, label, aliases))
    if included:
        rows = among(rows, "tag_id", included)
    if excluded:
        rows = among(rows, "tag_id", excluded, keep=False)
    scored = rows.withColumn("score", text.relevance(q, label, aliases))
    return scored.orderBy(F.desc("score"), F.col("last_searched").desc_nulls_last(), F.coalesce("count", F.lit(0)).desc(), "tag_id").limit(most)


def touched(tags: DataFrame, tag_id: str, now: Column) -> DataFrame:
    """tags after one was picked: it was searched last."""
    return tags.withColumn("last_searched", F.when(F.col("tag_id") == tag_id, now).otherwise(F.col("last_searched")))
