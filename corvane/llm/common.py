"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: For bytes.translate: A-Z to a-z, all other bytes as they are.
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; set here only where it is unset (local tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "/tmp/checkpoints/corvane"
    return f"{root.rstrip('/')}/corvane-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Shuffle files of the writes inside are deleted as soon as each write ends, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """Jobs that start inside hand Python so many rows at a time, where rows are large."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def materialize(df: DataFrame, name: str, free: bool = True, to: str | None = None, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut, and a lost executor costs no recomputation.

    A path in `to` is written over: what stood there, which df must not read, is no longer needed.
    """
    spark = df.sparkSession
    path = to or f"{shared_dir(spark)}-{name}"
    # Texts are large rows: a thousand of them at a time are enough for Python.
    with arrow_batches(spark, min(1_000, int(spark.conf.get(ARROW_ROWS)))), shuffles_freed(spark) if free else contextlib.nullcontext():
        df.write.mode("overwrite").option("parquet.block.size", str(32 << 20)).option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII texts take the faster built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_LOWER))


def crc32_mod(col: str, n: int) -> Column:
    """crc32 of a column as text, modulo n; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def shuffle_width(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def trim() -> None:
    """Give memory that this Python worker no longer uses back to the system; workers live on from task to task."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def deflated(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def inflated(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def summed(rows: DataFrame, column: str, size: int, parts: int = 16) -> np.ndarray:
    """The sum of packed arrays of one size: added up within tasks, then within `parts` tasks, then here."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total += inflated(data, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([deflated(total)], pa.binary())], [column])

    once = rows.select(column).mapInArrow(run, f"{column} binary")
    twice = once.repartition(parts).mapInArrow(run, f"{column} binary")
    return np.sum([np.zeros(size, np.int64), *(inflated(bytes(r[0]), "<i8") for r in twice.collect())], axis=0)  # at most `parts` rows


#: Rows that share a key up to which they may meet in one task.
HOT = 1_000


def join_by_key(rows: DataFrame, groups: DataFrame, key: list[str], spread: Column, n: str = "n", least: int = HOT) -> DataFrame:
    """rows left-joined with groups, one row of small values a key with the number of its rows in column n, which is dropped.

    Keys with more than `least` rows are broadcast, at most a millionth of all rows; all others are shuffled. spread tells
    rows of a key apart, so that a hot key's rows are no single task in that shuffle either. Null keys meet nothing.
    """
    values = [c for c in groups.columns if c not in (*key, n)]
    hot = groups.where(F.col(n) > least).select(*key, F.struct(*values).alias("_hot"))
    once = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(1 << 20)) + 1).otherwise(0))
    rest = groups.where(F.col(n) <= least).select(*key, F.struct(*values).alias("_rest"), F.lit(0).cast("long").alias("_salt"))
    out = once.withColumn("_salt", F.col("_salt").cast("long")).join(rest, [*key, "_salt"], "left")
    return out.select(*rows.columns, *(F.coalesce(F.col("_hot")[c], F.col("_rest")[c]).alias(c) for c in values))


def hot_bound(rows: int) -> int:
    """For join_by_key: from how many rows a key is hot, so that hot keys are at most a million."""
    return max(HOT, rows // 1_000_000)


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text): a user's row as one struct beside what an operator reads of it, so that no name of either can clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def unpacked(rows: DataFrame, names: list[str], **new: Column) -> DataFrame:
    """The user's columns again, some of them with new values."""
    return rows.select(*(new.get(c, F.col("row")[c]).alias(c) for c in names))


def with_window_hashes(df: DataFrame, words: str, length: int, out: str) -> DataFrame:
    """df with array<bigint> out: a hash for each window of `length` words, in order; empty where there are fewer words.

    Hashes of 1, 2, 4 ... words are joined pairwise, each step a column of its own, so a window costs a few
    hashes of two longs whatever its length.
    """
    df = df.withColumn(out, F.transform(words, lambda w: F.xxhash64(w)))
    have = 1
    while have < length:
        step = min(have, length - have)
        left = F.size(out) - step
        df = df.withColumn(out, F.when(left > 0, F.zip_with(F.slice(out, 1, left), F.slice(out, step + 1, left), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>")))
        have += step
    return df
