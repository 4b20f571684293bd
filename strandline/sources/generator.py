"""Load generator: deterministic random series ids, workers that own slices of them, counters as times and values."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def letters(key, n: int = 20):
    """n (up to 32) letters a to p drawn from two hashes of the key."""
    digits = F.concat(*[F.lpad(F.hex(F.xxhash64(key, F.lit(i))), 16, "0") for i in range(2)])
    return F.substring(F.translate(digits, "0123456789ABCDEF", "abcdefghijklmnop"), 1, n)


def series_ids(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.concat(letters(F.col("id")), F.lit("-"), F.col("id").cast("string")).alias("series_id"), "id")


def points(spark: SparkSession, n_points: int, n_series: int = 10_000, workers: int = 50) -> DataFrame:
    """Point k is worker k mod workers' (k div workers)-th: that counter is its time and value; its series is drawn from those
    whose number is the worker modulo workers, so no id is left without a worker. More workers than series share ids."""
    k = F.col("id")
    workers = min(workers, n_series)
    worker, counter = k % workers, F.expr(f"id div {workers}")
    slots = (F.lit(n_series) - worker + workers - 1) / workers
    number = worker + F.pmod(F.xxhash64(k, F.lit(3)), slots.cast("bigint")) * workers
    return spark.range(n_points).select(F.concat(letters(number), F.lit("-"), number.cast("string")).alias("series_id"), counter.alias("ts_nanos"), counter.cast("double").alias("value"), k.alias("arrival"))


def run(spark: SparkSession, path: str, n_points: int = 1_000_000, **options) -> dict:
    """Points per second from generation to committed Parquet."""
    from strandline.sources.store import write_points

    began = time.time()
    write_points(points(spark, n_points, **options), path, mode="overwrite")
    took = time.time() - began
    return {"points": n_points, "seconds": took, "points_per_second": n_points / took}
