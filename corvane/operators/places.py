"""Places in an order: an index that finds the n-th row, a page or a rank in one range of the order."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import shared_folder


@dataclass(frozen=True)
class OrderIndex:
    """(key, id) of all rows in ranges of the total order key, id (nulls first), and how many rows stand before each range."""

    entries: DataFrame
    before: list[int]
    key: str
    id_col: str

    @property
    def size(self) -> int:
        return self.before[-1]

    def _between(self, first: int, last: int) -> DataFrame:
        """Rows at ascending places first to last - 1, with their place; only the ranges that hold them are read."""
        first, last = max(0, first), min(last, self.size)
        low, high = bisect_right(self.before, first) - 1, bisect_right(self.before, max(first, last - 1)) - 1
        if first >= last:
            return self.entries.limit(0).withColumn("place", F.lit(0).cast("long")).drop("_range")
        inside = Window.partitionBy("_range").orderBy(F.col(self.key).asc_nulls_first(), self.id_col)
        start = F.element_at(F.lit(self.before[low : high + 1]).cast("array<long>"), F.col("_range") - low + 1)
        rows = self.entries.where(F.col("_range").between(low, high)).withColumn("place", start + F.row_number().over(inside) - 1)
        return rows.where(F.col("place").between(first, last - 1)).drop("_range")

    def between(self, first: int, last: int, descending: bool = False) -> DataFrame:
        """(key, id, place) of places first to last - 1 from 0 in either direction."""
        if not descending:
            return self._between(first, last)
        n = self.size
        return self._between(n - last, n - max(0, first)).withColumn("place", F.lit(n - 1) - F.col("place"))

    def page(self, number: int, size: int, descending: bool = False) -> DataFrame:
        first = max(0, number - 1) * size
        return self.between(first, first + size, descending)

    def neighbours(self, number: int, size: int, descending: bool = False, each_side: int = 250) -> DataFrame:
        """As search.neighbours(): from each_side before the start of a page, 2 * each_side + 1 rows."""
        first = max(0, (number - 1) * size - each_side)
        return self.between(first, first + 2 * each_side + 1, descending)

    def ranks(self, ids: DataFrame, descending: bool = False) -> DataFrame:
        """(id, rank) of some rows (id); each range that holds one is numbered by itself."""
        asked = self.entries.join(ids.select(self.id_col).distinct(), self.id_col, "left_semi")
        marks = asked.select("_range", F.col(self.id_col).alias("_id"))
        ranges = self.entries.join(asked.select("_range").distinct(), "_range", "left_semi")
        inside = Window.partitionBy("_range").orderBy(F.col(self.key).asc_nulls_first(), self.id_col)
        numbered = ranges.select("_range", F.col(self.id_col).alias("_id"), F.row_number().over(inside).alias("_n"))
        spark = self.entries.sparkSession
        starts = spark.createDataFrame(list(enumerate(self.before[:-1])), "_range int, _before long")  # a row a range
        got = numbered.join(marks, ["_range", "_id"], "left_semi").join(F.broadcast(starts), "_range")
        rank = F.col("_before") + F.col("_n") - 1
        return got.select(F.col("_id").alias(self.id_col), (F.lit(self.size - 1) - rank if descending else rank).alias("rank"))


def order_index(rows: DataFrame, key: str, id_col: str, ranges: int | None = None) -> OrderIndex:
    """An index over the order of search.ordered(). Spark samples the splitters, deals the rows by them once, and each range
    is a folder of its own, so a page, however deep, reads the folder it lies in and no task sorts or holds more than a range. The
    order the other way round is the same, read from its end. Ids are unique."""
    spark = rows.sparkSession
    path = shared_folder(spark)
    width = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = (F.col(key).asc_nulls_first(), F.col(id_col))
    dealt = rows.select(key, id_col).repartitionByRange(width, *by).withColumn("_range", F.spark_partition_id())
    dealt.write.partitionBy("_range").parquet(path)
    entries = spark.read.schema(dealt.schema).parquet(path)
    counts = {r["_range"]: r["count"] for r in entries.groupBy("_range").count().collect()}  # a row a range
    before = [0, *accumulate(counts.get(i, 0) for i in range(max(counts, default=-1) + 1))]
    return OrderIndex(entries, before, key, id_col)
