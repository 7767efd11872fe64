"""Queries that run a stream until it has caught up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import shared_folder, table
from corvane.streaming import events as ev


def event_fold(spark: SparkSession, folder: str) -> DataFrame:
    """The last event of each user, folded from a stream of the events table."""
    home = shared_folder(spark)
    rows = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    rows.write.parquet(f"{home}/in")
    stream = ev.read_events(spark, f"{home}/in", rows.schema.simpleString()[7:-1].replace(":", " "))
    out = ev.fold(spark, stream, "user_id", ["event_id"], ["event_id", "event_type"], f"{home}/state")
    return out.select("user_id", "event_id", "event_type", "n_events")


def stream_import(spark: SparkSession, folder: str) -> DataFrame:
    """Rows stored by a stream of import rows: each hash once, and every row that has none."""
    home = shared_folder(spark)
    rows = table(spark, folder, "documents").select("doc_id", F.when(F.col("doc_id") % 13 != 9, F.md5("text")).alias("hash"))
    rows.write.parquet(f"{home}/in")
    stream = ev.read_events(spark, f"{home}/in", "doc_id long, hash string")
    ev.import_stream(stream, f"{home}/store", f"{home}/state")
    return spark.read.schema("doc_id long, hash string").option("recursiveFileLookup", "true").parquet(f"{home}/store").select(F.coalesce("hash", F.concat(F.lit("none of "), "doc_id")).alias("hash"))


QUERIES = {"event_fold": event_fold, "stream_import": stream_import}
ORACLES = {
    "event_fold": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, count(*) AS n_events FROM events GROUP BY 1",
    "stream_import": "SELECT DISTINCT CASE WHEN doc_id % 13 <> 9 THEN md5(text) ELSE 'none of ' || doc_id END AS hash FROM documents",
}
