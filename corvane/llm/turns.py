"""Turns of conversations in their order, and conversations cut where they outgrow a task."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialize, shuffle_width


def placed(turns: DataFrame, *more: str) -> DataFrame:
    """(conv_id, turn, role, text, *more, place, block), written once.

    place numbers all rows by conversation and turn (nulls first; ties by role and text; rows that are the same in all of
    these stand side by side). block is the range of places that one task has sorted: a conversation of any size lies in
    as many blocks as it needs, and at most one conversation goes on over the border of two blocks.
    """
    spark = turns.sparkSession
    rows = turns.select("conv_id", "turn", "role", "text", *more).withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text", "_tie")]
    rows = rows.repartitionByRange(shuffle_width(spark), *by).sortWithinPartitions(*by).drop("_tie")
    return materialize(rows.withColumn("place", F.monotonically_increasing_id()).withColumn("block", F.shiftright("place", 33)), "turns")


@dataclass
class Crossing:
    """A conversation that lies in several blocks: what each block has of it, in order."""

    conv_id: object
    parts: list[dict] = field(default_factory=list)

    def total(self, name: str) -> int:
        return sum(p[name] for p in self.parts)


def crossings(rows: DataFrame, **sums: Column) -> list[Crossing]:
    """Conversations over the borders of blocks with sums for each block, at most one for each border."""
    each = rows.groupBy("conv_id", "block").agg(*(F.sum(c).cast("long").alias(n) for n, c in sums.items()))
    across = each.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("block", *sums))).alias("parts")).where("n > 1")
    return [Crossing(r["conv_id"], [p.asDict() for p in r["parts"]]) for r in across.collect()]  # at most one row a border


def in_pieces(rows: DataFrame, cuts: list[tuple], schema: str, defaults: dict[str, Column]) -> DataFrame:
    """rows with piece and what cuts say of it, dealt out by (conv_id, piece) and sorted by place in each.

    cuts: (conv_id, block, piece, *values) for conversations over the borders of blocks; all others are one piece, with the
    defaults for the values named in schema.
    """
    spark, kind = rows.sparkSession, dict(rows.dtypes)["conv_id"]
    if cuts:
        at = F.broadcast(spark.createDataFrame(cuts, f"_conv {kind}, _block long, _piece long, {schema}"))
        rows = rows.join(at, rows["conv_id"].eqNullSafe(at["_conv"]) & (rows["block"] == at["_block"]), "left").drop("_conv", "_block")
        rows = rows.withColumns({"piece": F.coalesce("_piece", F.lit(0)), **{n: F.coalesce(n, d) for n, d in defaults.items()}}).drop("_piece")
    else:
        rows = rows.withColumns({"piece": F.lit(0).cast("long"), **defaults})
    return rows.repartition(shuffle_width(spark), "conv_id", "piece").sortWithinPartitions("conv_id", "piece", "place")
