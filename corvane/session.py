"""Loading tables and cutting lineage."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share, under spark.checkpoint.dir; under /tmp only where a local session has none set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "/tmp/checkpoints/corvane"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df as written to the shared folder: lineage is cut, a lost executor costs no recomputation, and the plan knows its size."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys into four times the shuffle partitions, for wide steps whose tasks would hold much: groups and joins by keys need no shuffle after it."""
    return df.repartition(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def bucketed(df: DataFrame, key: str, lies: bool = False) -> DataFrame:
    """cut() by key into four times the shuffle partitions, each a bucket: joins and groups by key take its rows where they lie, and only the other side moves. lies: df comes from dealt(df, key).

    The catalog knows the table only until it is read; its files stay.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    name = f"corvane_{path[-32:]}"
    (df if lies else dealt(df, key)).write.format("parquet").bucketBy(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


#: Rows up to which a side of a join that is asked by key is broadcast.
BROADCAST_ROWS = 100_000


def probed(side: DataFrame) -> DataFrame:
    """side, of unique or few rows a key, as the hashed side of a join with many rows: broadcast where it is small, else dealt by key. The many are neither sorted nor held."""
    return F.broadcast(side) if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side.hint("shuffle_hash")


def broadcast_blocks(df: DataFrame, rows: int = 100_000) -> list[DataFrame]:
    """df in parts of about so many rows, each small enough to broadcast; a counted small table is one part."""
    parts = max(1, -(-df.count() // rows))
    return [F.broadcast(df if parts == 1 else df.where(F.pmod(F.xxhash64(*df.columns), F.lit(parts)) == i)) for i in range(parts)]


#: Ids up to which a list stands in the plan; longer ones are joined.
INLINE_IDS = 1_000


def among(rows: DataFrame, column: str, ids, keep: bool = True) -> DataFrame:
    """Rows whose column is one of ids, or with keep false none of them (null is none). A long list is joined, not written into the plan."""
    ids = [i for i in dict.fromkeys(ids) if i is not None]
    if len(ids) <= INLINE_IDS:
        inside = F.col(column).isin(*ids)
        return rows.where(inside if keep else ~F.coalesce(inside, F.lit(False)))
    asked = rows.sparkSession.createDataFrame([(i,) for i in ids], f"{column} {dict(rows.dtypes)[column]}")
    return rows.join(asked, column, "left_semi" if keep else "left_anti").select(*rows.columns)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
