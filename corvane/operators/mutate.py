"""Changes to tables as new snapshots: frames in, frames out."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.operators.predicates import missing_original


def insert(rows: DataFrame, new: DataFrame, defaults: dict | None = None) -> DataFrame:
    for name, value in (defaults or {}).items():
        new = new.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in new.columns else F.lit(value))
    return rows.unionByName(new, allowMissingColumns=True)


def delete(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    return rows.join(ids.select(id_col), id_col, "left_anti").select(*rows.columns)


def update(rows: DataFrame, changes: DataFrame, id_col: str, nulls: tuple = ()) -> DataFrame:
    """Columns of changes that are not null replace those of the row with the same id; those named in nulls do so even where null."""
    named = changes.select(id_col, F.lit(True).alias("_hit"), *(F.col(c).alias(f"_new_{c}") for c in changes.columns if c != id_col))
    out = rows.join(named, id_col, "left")

    def value(c: str) -> Column:
        if c == id_col or c not in changes.columns:
            return F.col(c)
        return (F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) if c in nulls else F.coalesce(f"_new_{c}", c)).alias(c)

    return out.select(*map(value, rows.columns))


def upsert(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New keys are added, known ones left as they are. Null is a key like any other: it is added once."""
    fresh = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*[c for c in new.columns if c != key] or [key]))).where("_n = 1").drop("_n")
    known = rows.select(F.col(key).alias("_known")).distinct()
    return rows.unionByName(fresh.join(known, fresh[key].eqNullSafe(known["_known"]), "left_anti").select(*new.columns), allowMissingColumns=True)


def steps(start: DataFrame, *changes: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return reduce(lambda df, change: change(df), changes, start)


def add_to_set(array: Column, ids: list) -> Column:
    return F.array_union(F.coalesce(array, F.array().cast("array<string>")), F.array(*map(F.lit, ids)))


def pull(array: Column, ids: list) -> Column:
    """All of these ids go; other repeats stay."""
    return F.filter(array, lambda x: ~x.isin(*ids))


def delta(before: Column, after: Column) -> tuple[Column, Column]:
    """(added, removed)"""
    return F.array_except(after, before), F.array_except(before, after)


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def replaced(array: Column, gone: str, kept: str, opposite: Column) -> Column:
    """gone becomes kept, or goes where kept stands on the opposite side; once each."""
    clash = F.coalesce(F.array_contains(opposite, kept), F.lit(False))
    return F.array_distinct(F.transform(F.filter(array, lambda x: ~((x == gone) & clash)), lambda x: F.when(x == gone, kept).otherwise(x)))


def concat_without(parts: list[Column], unwanted: Column, start: int, most: int) -> Column:
    """Arrays laid end to end, without some values, cut to `most` from place `start` (from 0)."""
    return F.slice(F.filter(F.concat(*parts), lambda x: ~F.coalesce(F.array_contains(unwanted, x), F.lit(False))), start + 1, most)


def unset(rows: DataFrame, path: str) -> DataFrame:
    """rows without a field, at the top or within structs (a.b.c); where it isn't there, or is left from an older schema, nothing else changes."""
    top, *inner = path.split(".")
    if top not in rows.columns:
        return rows
    if not inner:
        return rows.drop(top)
    kind = rows.schema[top].dataType
    for name in inner:
        if not isinstance(kind, StructType) or name not in kind.names:
            return rows
        kind = kind[name].dataType
    return rows.withColumn(top, F.col(top).dropFields(".".join(inner)))


def divided(rows: DataFrame, test: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass a test and all others, null among them."""
    passed = F.coalesce(test, F.lit(False))
    return rows.where(passed), rows.where(~passed)


def with_row_status(imports: Column, path: str, status: str, **fields) -> Column:
    """The import rows with that path, changed in place."""

    def changed(x: Column) -> Column:
        y = x.withField("status", F.lit(status))
        for name, value in fields.items():
            y = y.withField(name, F.lit(value))
        return F.when(x["path"] == path, y).otherwise(x)

    return F.transform(imports, changed)


def delete_files(files: DataFrame, members: DataFrame, tombstones: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, members, tombstones) after files (file_id) are deleted; collections left empty go with their last row."""
    left = delete(files, gone, "file_id")
    hashes = files.join(gone.select("file_id"), "file_id", "left_semi").select("hash").where("hash is not null")
    return left, delete(members, gone, "file_id"), tombstones.select("hash").union(hashes).distinct()


def delete_external(tombstones: DataFrame, found: DataFrame) -> DataFrame:
    """Tombstones with the hashes of files (path, hash) that are deleted outside the library, once each."""
    return upsert(tombstones.select("hash"), found.where("hash is not null").select("hash").distinct(), "hash")


def originals_filled(rows: DataFrame, chosen: Column, pairs: dict[str, str]) -> DataFrame:
    """Chosen rows with what is missing of the originals (column -> original) taken from the present values."""
    return rows.withColumns({o: F.when(chosen & missing_original(c, o), F.col(c)).otherwise(F.col(o)) for c, o in pairs.items()})


def delete_or_archive(files: DataFrame, chosen: DataFrame) -> DataFrame:
    """(file_id, action): archived ones are deleted, others archived."""
    return files.join(chosen.select("file_id"), "file_id", "left_semi").select("file_id", F.when(F.coalesce("is_archived", F.lit(False)), "delete").otherwise("archive").alias("action"))
