"""Ordered batches of changes to a table of many files: only files that hold a changed id are written anew."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.session import cut

#: Where the list of a table's files stands, a folder for each version.
MANIFESTS = "manifests"


@dataclass(frozen=True)
class Table:
    """A version of a table: its files with the least and greatest id in each."""

    spark: SparkSession
    folder: str
    id_col: str
    version: int
    manifest: DataFrame  # file, low, high, n_rows
    schema: str

    def rows(self) -> DataFrame:
        files = [r["file"] for r in self.manifest.select("file").collect()]  # a row a file
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*files)

    def rows_of(self, ids: DataFrame) -> DataFrame:
        """Rows with these ids; files whose range of ids holds none of them aren't read."""
        asked = ids.select(F.col(self.id_col).alias("_id"))
        low = asked.agg(F.min("_id").alias("a"), F.max("_id").alias("b")).first()
        files = [r["file"] for r in self.manifest.where((F.col("high") >= F.lit(low["a"])) & (F.col("low") <= F.lit(low["b"]))).select("file").collect()]
        rows = self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)
        return rows.join(asked.withColumnRenamed("_id", self.id_col).distinct(), self.id_col, "left_semi")


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Versions whose manifest was written to its end."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{MANIFESTS}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = [s.getPath() for s in fs.listStatus(path) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("v")) for p in done if p.getName().startswith("v"))


def _written(rows: DataFrame, folder: str, id_col: str, files: int) -> DataFrame:
    """(file, low, high, n_rows) of rows written to a folder of their own, in ranges of ids."""
    rows.repartitionByRange(max(1, files), id_col).sortWithinPartitions(id_col).write.parquet(folder)
    back = rows.sparkSession.read.schema(rows.schema).parquet(folder)
    return back.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(id_col).alias("low"), F.max(id_col).alias("high"), F.count("*").alias("n_rows"))


def create(rows: DataFrame, folder: str, id_col: str, files: int) -> Table:
    """A table of about so many files, sorted by id."""
    manifest = _written(rows, f"{folder}/data/v0", id_col, files)
    manifest.coalesce(1).write.parquet(f"{folder}/{MANIFESTS}/v0")
    return open_table(rows.sparkSession, folder, id_col, rows.schema.simpleString()[7:-1].replace(":", " "))


def open_table(spark: SparkSession, folder: str, id_col: str, schema: str) -> Table:
    """The last version whose manifest was finished; what a batch that failed left beside it is not part of the table."""
    version = _versions(spark, folder)[-1]
    return Table(spark, folder, id_col, version, cut(spark.read.parquet(f"{folder}/{MANIFESTS}/v{version}")), schema)


def settled(changes: DataFrame, id_col: str) -> DataFrame:
    """The last word on each id of an ordered batch (seq, op, row columns): an upsert's row or a deletion.

    op: insert, update, upsert or delete; the change with the greatest seq counts, as each one gives the whole row.
    """
    last = Window.partitionBy(id_col).orderBy(F.desc("seq"))
    return changes.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def apply_batch(table: Table, changes: DataFrame) -> Table:
    """The next version after an ordered batch (seq, op, and the table's columns) of whole-row inserts, updates and deletions.

    The zones of the manifest leave the files that may hold a changed id; their id column alone then says which do. These
    files are written anew without the rows that go or change, inserts go to files of their own, and all other files stay
    as they are, name and bytes. The new manifest comes last: until it is finished the old version is the table.
    """
    spark, key = table.spark, table.id_col
    names = [f.strip().split(" ")[0] for f in _fields(table.schema)]
    final = cut(settled(changes, key))
    zones = table.manifest.select("file", "low", "high")
    spots = final.select(F.col(key).alias("_id")).join(F.broadcast(zones), F.col("_id").between(F.col("low"), F.col("high"))).select("file").distinct()
    some = [r["file"] for r in spots.collect()]  # a row a file at most
    known = spark.createDataFrame([], "file string")
    if some:
        ids = spark.read.schema(table.schema).parquet(*some).select(key, F.col("_metadata.file_path").alias("file"))
        known = ids.join(final.select(key), key, "left_semi").select("file").distinct()
    hit = [r["file"] for r in known.collect()]
    put = final.where("op <> 'delete'").select(*names)
    parts = put
    if hit:
        old = spark.read.schema(table.schema).parquet(*hit).join(final.select(key), key, "left_anti").select(*names)
        parts = old.unionByName(put)
    version = table.version + 1
    fresh = _written(parts, f"{table.folder}/data/v{version}", key, max(1, len(hit)))
    kept = table.manifest.where(~F.col("file").isin(*hit)) if hit else table.manifest
    kept.unionByName(fresh).coalesce(1).write.mode("overwrite").parquet(f"{table.folder}/{MANIFESTS}/v{version}")
    return open_table(spark, table.folder, key, table.schema)


def _fields(schema: str) -> list[str]:
    """The columns of a schema string, commas within types aside."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[start:i])
            start = i + 1
    return [*out, schema[start:]]
