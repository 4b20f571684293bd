"""Reads: one series, many series, time ranges; stored and buffered points merged in time order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(*runs: DataFrame) -> DataFrame:
    """All points of stored chunks and of the unflushed buffer; equal timestamps all stay."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def series_read(points: DataFrame, series_id: str, order: str = "arrival") -> DataFrame:
    """One series in time order, ties by arrival; an unknown series gives no rows. The id filter reaches the scan."""
    return points.where(F.col("series_id") == series_id).orderBy("ts_nanos", order)


def read_batch(points: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    """Points of the wanted series. A list becomes an IN filter that reaches the scan; a DataFrame of ids a semi-join, for which
    Spark broadcasts the ids only under its size threshold."""
    if isinstance(ids, DataFrame):
        return points.join(ids.select("series_id").distinct(), "series_id", "left_semi")
    return points.where(F.col("series_id").isin(list(ids)))


def responses(points: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per wanted id, unknown ones with no datapoints: (series_id, datapoints in time order)."""
    points_of = points.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("ts_nanos", "value"))).alias("datapoints"))
    empty = F.array().cast("array<struct<ts_nanos:bigint,value:double>>")
    return ids.select("series_id").distinct().join(points_of, "series_id", "left").withColumn("datapoints", F.coalesce("datapoints", empty))


def range_read(points: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Points in [start_ns, end_ns)."""
    return points.where((F.col("ts_nanos") >= F.lit(start_ns)) & (F.col("ts_nanos") < F.lit(end_ns)))
