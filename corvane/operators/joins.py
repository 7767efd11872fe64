"""Matching files with stored hashes, folders, patterns and vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.patterns import tags_by_pattern  # noqa: F401 - part of this module's interface
from corvane.operators.search import with_tags
from corvane.session import among, broadcast_blocks, cut, union


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def known_hashes(rows: DataFrame, files: DataFrame, tombstones: DataFrame) -> DataFrame:
    """rows with is_duplicate (the hash is stored) and is_deleted (it was deleted before)."""
    a = files.select("hash").distinct().withColumn("_dup", F.lit(True))
    b = tombstones.select("hash").distinct().withColumn("_del", F.lit(True))
    out = rows.join(a, "hash", "left").join(b, "hash", "left")
    return out.withColumns({"is_duplicate": F.col("_dup").isNotNull(), "is_deleted": F.col("_del").isNotNull()}).drop("_dup", "_del")


def storage_diff(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(path, side): paths in the table but not in storage, and the other way round."""
    missing = stored.select("path").distinct().join(found.select("path"), "path", "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(found.select("path").distinct().join(stored.select("path"), "path", "left_anti").withColumn("side", F.lit("unknown")))


def relink(files: DataFrame, found: DataFrame) -> DataFrame:
    """(file_id, old_path, new_path): files found elsewhere by name, case aside; the greatest path wins, unmoved ones are left out."""
    places = found.groupBy(F.lower(basename(F.col("path"))).alias("name")).agg(F.max("path").alias("new_path"))
    named = files.select("file_id", F.col("original_path").alias("old_path"), F.lower(basename(F.col("original_path"))).alias("name"))
    return named.join(places, "name").where("old_path <> new_path").select("file_id", "old_path", "new_path")


def holding_any(file_tags: DataFrame, tag_ids: list) -> DataFrame:
    return among(file_tags, "tag_id", tag_ids).select("file_id").distinct()


def collections_of(members: DataFrame, files: DataFrame) -> DataFrame:
    return members.join(files.select("file_id").distinct(), "file_id", "left_semi").select("collection_id").distinct()


def collections_with_tags(collections: DataFrame, members: DataFrame, files: DataFrame, collection_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Collections that hold any of the files, each with an array of its tags (tag_id, label)."""
    hit = collections.join(collections_of(members, files), "collection_id", "left_semi")
    return with_tags(hit, collection_tags, tags, "collection_id")


def relinked_imports(imports: DataFrame, moves: DataFrame) -> DataFrame:
    """Import rows (file_id, path, thumb_path ...) of moved files (file_id, new_path) with the new path and the picture beside it."""
    named = moves.groupBy("file_id").agg(F.max("new_path").alias("_new"))
    thumb = F.concat(F.regexp_replace("_new", r"\.[^./]*$", ""), F.lit("-thumb.jpg"))
    out = imports.join(named, "file_id", "left")
    return out.withColumns({"path": F.coalesce("_new", "path"), "thumb_path": F.coalesce(thumb, "thumb_path")}).select(*imports.columns)


def by_label(rows: DataFrame, tags: DataFrame, label: str = "label") -> DataFrame:
    """rows with tag_id, the tag of that very label (the least id), null where there is none."""
    known = tags.groupBy(F.col("label").alias("_label")).agg(F.min("tag_id").alias("tag_id"))
    return rows.join(known, rows[label] == known["_label"], "left").drop("_label")


def _gap() -> Column:
    return F.sqrt(F.aggregate(F.zip_with("vector", "known_vector", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))


def nearest(faces: DataFrame, known: DataFrame, most: float = 0.45) -> DataFrame:
    """(face_id, tag_id, distance): for each vector the nearest known one within a distance; the known ones are a stated set, met in blocks."""
    met = [faces.join(block, F.size("vector") == F.size("known_vector")) for block in broadcast_blocks(known.select("tag_id", "known_vector"), 10_000)]
    pairs = union(met).withColumn("distance", _gap()).where(F.col("distance") <= most)
    w = Window.partitionBy("face_id").orderBy("distance", "tag_id")
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("face_id", "tag_id", "distance")


#: Vectors that lie together in one row, and faces that are broadcast at once.
BLOCK, FACES = 2_000, 50_000


def _blocks(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys as arrays, dim and mat (doubles, row by row): up to BLOCK vectors of one size a row. Vectors that are null or hold a null or no number have no distance and are left out."""
    names, kinds = [*keys, "dim", "mat"], dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, dims = batch.column(len(keys)), batch.column(len(keys)).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                mat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), dim)
                sure = np.isfinite(mat).all(axis=1)
                at, mat = at[sure], mat[sure]
                for k in range(0, len(at), BLOCK):
                    part = pa.array(at[k : k + BLOCK])
                    yield pa.RecordBatch.from_pydict({**{c: [batch.column(j).take(part).to_pylist()] for j, c in enumerate(keys)}, "dim": [dim], "mat": [mat[k : k + BLOCK].tobytes()]}, schema)

    schema = pa.schema([(c, pa.list_({"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[kinds[c]])) for c in keys] + [("dim", pa.int32()), ("mat", pa.binary())])
    full = rows.select(*keys, F.col(vector).cast("array<double>").alias("_v")).where(F.col("_v").isNotNull())
    return full.mapInArrow(run, ", ".join([f"{c} array<{kinds[c]}>" for c in keys] + ["dim int", "mat binary"])).select(*names)


def _best(x: np.ndarray, y: np.ndarray, own: list[list[int]], most: float) -> Iterator[tuple[int, int, float]]:
    """(row of x, row of y, distance) of all pairs that may be the nearest of a row of x within `most`; own: rows of y that are left out.

    Products of matrices give each distance within what rounding can do to it; those that may be least are then worked out term by term.
    """
    slack = 8 * (x.shape[1] + 2) * np.finfo(float).eps
    xx, yy, inner = (x * x).sum(axis=1)[:, None], (y * y).sum(axis=1)[None, :], x @ y.T
    inner *= -2
    inner += xx + yy
    for i, js in enumerate(own):
        inner[i, js] = np.inf
    room = slack * (xx + yy)
    limit = np.minimum((inner + room).min(axis=1), most * most * (1 + slack))
    rows, cols = np.nonzero(inner - room <= limit[:, None])
    for k in range(0, len(rows), 100_000):
        i, j = rows[k : k + 100_000], cols[k : k + 100_000]
        total = np.zeros(len(i))
        for c in range(x.shape[1]):
            gap = x[i, c] - y[j, c]
            total += gap * gap
        yield from zip(i.tolist(), j.tolist(), np.sqrt(total).tolist())


def nearest_other(faces: DataFrame, known: DataFrame, most: float = 0.45) -> DataFrame:
    """(face_id, tag_id, distance): as nearest(), but each vector's own row is left out and blocks of faces meet all known ones, which may be the larger side.

    Whole blocks meet by products of matrices; a task keeps the best of each face of a broadcast block.
    """
    spark, kind = faces.sparkSession, dict(faces.dtypes)["face_id"]
    sides = known.where("tag_id is not null").select("tag_id", "known_vector").repartition("tag_id"), faces.where("face_id is not null").select("face_id", F.col("face_id").cast("string").alias("key"), "vector")
    known_blocks = cut(_blocks(sides[0], ["tag_id"], "known_vector"))
    out_kind = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {}
        for batch in batches:
            for r in batch.to_pylist():
                x, y = (np.frombuffer(r[c]).reshape(len(r[ids]), r["dim"]) for c, ids in (("face_mat", "face_id"), ("mat", "tag_id")))
                place = {}
                for j, t in enumerate(r["tag_id"]):
                    place.setdefault(t, []).append(j)
                for i, j, d in _best(x, y, [place.get(k, []) for k in r["key"]], most):
                    if d <= most and ((f := r["face_id"][i]) not in best or (d, r["tag_id"][j]) < best[f]):
                        best[f] = (d, r["tag_id"][j])
        yield pa.RecordBatch.from_arrays([pa.array(best, out_kind), pa.array([d for d, _ in best.values()], pa.float64()), pa.array([t for _, t in best.values()], pa.string())], ["face_id", "distance", "tag_id"])

    found, setting = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    for block in broadcast_blocks(sides[1], FACES):
        packed = cut(_blocks(block, ["face_id", "key"], "vector").withColumnRenamed("mat", "face_mat"))
        spark.conf.set(setting, "4")  # rows of this job are blocks
        try:
            found.append(cut(known_blocks.join(F.broadcast(packed), "dim").select("dim", "tag_id", "mat", "face_id", "key", "face_mat").mapInArrow(run, f"face_id {kind}, distance double, tag_id string")))
        finally:
            spark.conf.set(setting, before)
    near = union(found).groupBy("face_id").agg(F.min(F.struct("distance", "tag_id")).alias("x"))
    return near.select("face_id", "x.tag_id", "x.distance")
