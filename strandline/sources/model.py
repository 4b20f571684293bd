"""Canonical points and the mapping of the test tables to them.

A point is (series_id STRING, ts_nanos LONG, value DOUBLE); ingest adds arrival (order of writing), seq (order of a feed), stream
and epoch (flush interval). Timestamps are nanoseconds since 1970 in a LONG: Spark's own timestamps stop at microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("series_id", T.StringType()), T.StructField("ts_nanos", T.LongType()), T.StructField("value", T.DoubleType())])
WRITE = T.StructType([*POINT.fields, T.StructField("arrival", T.LongType())])


def nanos(ts: Column) -> Column:
    """Nanoseconds of a zoneless timestamp, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz")) * F.lit(1000).cast("bigint")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per user; arrival is a fixed shuffle of the event order, epoch the day, stream the event type."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("series_id"), nanos(F.col("ts")).alias("ts_nanos"), "value", F.col("event_id").alias("seq"), F.col("event_type").alias("stream"),
        ((F.col("event_id") * 7919) % 1000003).alias("arrival"), F.col("ts").cast("date").alias("epoch"),
    )


def hourly_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per event type at hour grain: a feed in which many points share (series_id, ts_nanos)."""
    e = table(spark, sf_dir, "events")
    hour = F.lit(3_600_000_000_000).cast("bigint")
    return e.select(F.col("event_type").alias("series_id"), (F.floor(nanos(F.col("ts")) / hour).cast("bigint") * hour).alias("ts_nanos"), "value", F.col("event_id").alias("seq"))


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per customer, in order-key order: a naturally disordered feed."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").cast("string").alias("series_id"), nanos(F.col("o_orderdate")).alias("ts_nanos"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("arrival"))


def customer_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags (tag_key, tag_value, series_id) of the order series: market segment and nation."""
    c = table(spark, sf_dir, "customer")
    pairs = F.array(F.struct(F.lit("mktsegment").alias("k"), F.col("c_mktsegment").alias("v")), F.struct(F.lit("nation").alias("k"), F.col("c_nationkey").cast("string").alias("v")))
    return c.select(F.col("c_custkey").cast("string").alias("series_id"), F.explode(pairs).alias("tag")).select(F.col("tag.k").alias("tag_key"), F.col("tag.v").alias("tag_value"), "series_id")


def valid(points: DataFrame) -> DataFrame:
    """Points that can be stored: an id, a time and a value; unsigned wire times past 2**63 - 1 have no LONG and arrive as null."""
    return points.where("series_id IS NOT NULL AND ts_nanos IS NOT NULL AND value IS NOT NULL")
