"""Change events and imports as streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


def read_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(folder)


def latest_state(events: DataFrame, key: str, order: list[str], value: list[str]) -> DataFrame:
    """The last event of each key, and how many there were; the same frame works on streams and on tables."""
    newest = F.max_by(F.struct(*value), F.struct(*order))
    return events.groupBy(key).agg(newest.alias("last"), F.count("*").alias("n_events")).select(key, "last.*", "n_events")


def throttled(writer, every: str | None):
    """A stream writer that starts a batch at most so often ("2 seconds"); without an interval it stops when it has caught up."""
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def fold(spark: SparkSession, events: DataFrame, key: str, order: list[str], value: list[str], checkpoint: str) -> DataFrame:
    """Run the stream until it has caught up; the state of all keys, from Parquet.

    Each micro-batch writes the keys it changed to a folder of its own beside the checkpoint; the latest row of a key counts.
    A batch that is run again writes the same folder again.
    """
    state = latest_state(events, key, order, value)
    home = f"{checkpoint.rstrip('/')}-rows"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{home}/batch-{number:09d}")

    throttled(state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint), None).start().awaitTermination()
    spark.createDataFrame([], state.schema).withColumn("_batch", F.lit(0).cast("long")).write.mode("overwrite").parquet(f"{home}/empty")
    rows = spark.read.option("recursiveFileLookup", "true").parquet(home)
    names = state.columns
    return rows.groupBy(key).agg(F.max_by(F.struct(*(F.col(c) for c in names if c != key)), "_batch").alias("last")).select(key, "last.*")


class FirstOfHash(StatefulProcessor):
    """Passes the first row of each hash on, and none where the store held the hash before the stream began."""

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInitialState(self, key, initial, timers) -> None:
        self.seen.update((True,))

    def handleInputRows(self, key, rows, timers):
        rows = pd.concat(list(rows))
        if not self.seen.exists():
            self.seen.update((True,))
            yield rows.sort_values(self.names, kind="stable")[:1]


def import_stream(rows: DataFrame, store: str, checkpoint: str, every: str | None = None):
    """Append rows with new hashes to the store (a Parquet folder of one folder a batch), micro-batch by micro-batch.

    Which hashes are known is state of the stream, keyed by hash: it is loaded from the store once, when the stream first
    starts, and a batch looks up its own hashes only, so its time doesn't grow with the store. Of rows that share a new
    hash in one batch the least stays. Rows without a hash can't be known and are all kept. A batch that is run again finds the
    state it began with and writes its folder again, so nothing is lost or stored twice. With an interval the running
    query is returned, a batch at most so often; without one it runs until it has caught up.
    """
    spark = rows.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.createDataFrame([], rows.schema).write.mode("append").parquet(f"{store}/known")  # so that there is something to read
    known = spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(store).where("hash is not null").select("hash").distinct()
    processor = FirstOfHash(rows.columns)
    fresh = rows.where("hash is not null").groupBy("hash").transformWithStateInPandas(processor, rows.schema, "Append", "None", known.groupBy("hash"))
    # One query over one source: the rows without a hash go beside the state.
    out = fresh.unionByName(rows.where("hash is null"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch-{number:09d}")

    query = throttled(out.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), every).start()
    if every:
        return query
    query.awaitTermination()
    return None
