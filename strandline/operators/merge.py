"""Merging sorted runs, and cutting a disordered feed into sorted runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.rank import place


def kway_merge(points: DataFrame, stream: str = "stream", block: int | None = None) -> DataFrame:
    """All streams of a series in time order with their place in it; ties by stream, then value. Sorting spills, so the number
    of streams and points is not bound by memory. block: nanoseconds of a run (see rank.place), for hot series."""
    return place(points, ["series_id"], ["ts_nanos", stream, "value"], block)


def merge_streams(streams: DataFrame) -> DataFrame:
    """One encoded stream per series from several: rows (series_id, data) are decoded, merged by time and encoded again."""
    from strandline.functions import codec

    points = codec.decode(streams)
    return codec.encode(points.withColumn("arrival", F.col("place")), order=["ts_nanos", "arrival"])


def run_split(points: DataFrame, order: str = "arrival", block: int | None = None) -> DataFrame:
    """Adds run: the number of earlier points of the series that did not pass their predecessor, so each run is sorted.

    Points of equal order stand by time, then value, those of no order last. With `block`, a series is cut into stretches of that
    many order values: their breaks are summed and scanned first, and the first point of a stretch is held against the last one
    before it, so a hot series spreads over tasks."""
    # __part is one struct, as joins leave out null columns but not structs that hold some
    key = "series_id" if block is None else "__part"
    rows = points if block is None else points.withColumn("__part", F.struct("series_id", F.floor(F.col(order) / block).alias("no")))
    by = Window.partitionBy(key).orderBy(*map(F.asc_nulls_last, (order, "ts_nanos", "value")))
    broke = F.coalesce((F.col("ts_nanos") <= F.lag("ts_nanos").over(by)).cast("bigint"), F.lit(0).cast("bigint"))
    rows = rows.withColumn("__broke", broke).withColumn("run", F.sum("__broke").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("__broke")
    if block is None:
        return rows
    edge = F.struct(F.col(order).alias("o"), F.isnull("ts_nanos"), F.col("ts_nanos").alias("t"))  # of equal order the same point as in the window
    parts = rows.groupBy(key).agg(F.min(edge)["t"].alias("__first"), F.max(edge)["t"].alias("__last"), F.max("run").alias("__breaks"))
    over = Window.partitionBy("__part.series_id").orderBy(F.asc_nulls_last("__part.no"))
    parts = parts.withColumn("__cross", F.coalesce((F.col("__first") <= F.lag("__last").over(over)).cast("bigint"), F.lit(0).cast("bigint")))
    before = F.coalesce(F.sum(F.col("__breaks") + F.col("__cross")).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    parts = parts.select(key, (before + F.col("__cross")).alias("__before"))
    return rows.join(parts, key).withColumn("run", F.col("run") + F.col("__before")).drop("__part", "__before")
