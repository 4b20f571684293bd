"""Tag index: rows (tag_key, tag_value, series_id); exact, OR, AND, NOT and regex lookups, integer ids, bitmap postings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def term(key: str, value: str) -> Column:
    return (F.col("tag_key") == key) & (F.col("tag_value") == value)


def exact(tags: DataFrame, key: str, value: str) -> DataFrame:
    return tags.where(term(key, value)).select("series_id").distinct()


def any_of(tags: DataFrame, terms: list[tuple[str, str]]) -> DataFrame:
    """Series with at least one of the terms: one scan with a disjunction."""
    return tags.where(reduce(lambda a, b: a | b, [term(*t) for t in terms])).select("series_id").distinct()


def all_of(tags: DataFrame, terms: list[tuple[str, str]]) -> DataFrame:
    """Series with every term: one scan and one aggregation instead of an intersection for each term."""
    wanted = list(dict.fromkeys(terms))
    hits = tags.where(reduce(lambda a, b: a | b, [term(*t) for t in wanted]))
    return hits.groupBy("series_id").agg(F.count_distinct("tag_key", "tag_value").alias("n")).where(F.col("n") == len(wanted)).select("series_id")


def none_of(tags: DataFrame, terms: list[tuple[str, str]]) -> DataFrame:
    """Series of the index without any of the terms."""
    has = F.max(reduce(lambda a, b: a | b, [term(*t) for t in terms]).cast("int"))
    return tags.groupBy("series_id").agg(F.coalesce(has, F.lit(0)).alias("has")).where("has = 0").select("series_id")


def regex(tags: DataFrame, key: str, pattern: str) -> DataFrame:
    """Series whose value of the key matches: the pattern runs once per distinct value, then a semi-join."""
    values = tags.where(F.col("tag_key") == key).select("tag_value").distinct().where(F.col("tag_value").rlike(pattern))
    return tags.where(F.col("tag_key") == key).join(values, "tag_value", "left_semi").select("series_id").distinct()


def dictionary(ids: DataFrame, parts: int = 4096) -> DataFrame:
    """(series_id, series_no): dense integers from 0 in the order of (bucket, id). Buckets are counted and their offsets
    summed, so ids are ranked within buckets only."""
    rows = ids.select("series_id").distinct().withColumn("bucket", F.pmod(F.xxhash64("series_id"), F.lit(parts)))
    sums = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))  # at most `parts` rows
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("bucket").orderBy("series_id")) - 1
    return rows.withColumn("own", own).join(F.broadcast(sums.select("bucket", "before")), "bucket").select("series_id", (F.col("before") + F.col("own")).cast("bigint").alias("series_no"))


def postings(tags: DataFrame, numbers: DataFrame) -> DataFrame:
    """(tag_key, tag_value, bucket, bitmap): bitmaps of series numbers, one per term and bucket of Spark's fixed size."""
    rows = tags.join(numbers, "series_id")
    return rows.groupBy("tag_key", "tag_value", F.expr("bitmap_bucket_number(series_no)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(series_no))").alias("bitmap"))


def posting_counts(bitmaps: DataFrame) -> DataFrame:
    return bitmaps.groupBy("tag_key", "tag_value").agg(F.sum(F.expr("bitmap_count(bitmap)")).cast("bigint").alias("n_series"))
