"""The commit log as tables: records, group-committed chunks, rotation, truncation, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_BYTES = 98_304
QUEUE_BYTES = 10_000_000


def record(points: DataFrame) -> DataFrame:
    """Log records: the write as one JSON payload, decodable on its own."""
    return points.withColumn("payload", F.to_json(F.struct("series_id", "ts_nanos", "value")).cast("binary"))


def parse_record(payload: Column) -> Column:
    return F.from_json(payload.cast("string"), "series_id string, ts_nanos bigint, value double")


def running_bytes(rows: DataFrame, order: str, size: Column, block: int = 1_000_000) -> DataFrame:
    """Adds start_offset: bytes of all rows before this one in `order` (whole numbers).

    Order values are cut into blocks; block sums (one row per million order values) are scanned, rows only within their block,
    so no task sorts the whole log."""
    rows = rows.withColumn("__size", size.cast("bigint")).withColumn("__block", F.floor(F.col(order) / block))
    sums = rows.groupBy("__block").agg(F.sum("__size").alias("__sum"))
    before = F.sum("__sum").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("__block", F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.sum("__size").over(Window.partitionBy("__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    out = rows.join(sums, "__block").withColumn("start_offset", (F.coalesce(own, F.lit(0)) + F.col("__before")).cast("bigint"))
    return out.drop("__block", "__before", "__size")


def log_chunks(rows: DataFrame, order: str, size: Column, first_idx: int = 0) -> DataFrame:
    """Adds chunk_idx: records fill chunks of CHUNK_BYTES by their start offset; a record is never cut. Empty records are refused."""
    placed = running_bytes(rows.where(size > 0), order, size)
    return placed.withColumn("chunk_idx", F.expr(f"start_offset div {CHUNK_BYTES}") + first_idx)


def queue_admits(rows: DataFrame, order: str, size: Column, most: int = QUEUE_BYTES) -> DataFrame:
    """Adds accepted: whether the pending bytes before the record are within the queue's bound (of one flush interval)."""
    return running_bytes(rows, order, size).withColumn("accepted", F.col("start_offset") <= F.lit(most)).drop("start_offset")


def latest_index(log: DataFrame) -> DataFrame:
    """One row, latest: the last chunk index, -1 for an empty log."""
    return log.agg(F.coalesce(F.max("chunk_idx"), F.lit(-1)).cast("bigint").alias("latest"))


def rotation_token(log: DataFrame) -> DataFrame:
    """One row, token: the index the next chunk will get; everything below it is flushed."""
    return latest_index(log).select((F.col("latest") + 1).alias("token"))


def truncate(log: DataFrame, token: int | None) -> DataFrame:
    """The log without chunks below the token; without a token it stays whole."""
    return log if token is None else log.where(F.col("chunk_idx") >= F.lit(token))


def replay(stored: DataFrame, log: DataFrame) -> DataFrame:
    """Stored points and logged ones, each (series_id, ts_nanos) once; the logged value wins, later records over earlier ones."""
    both = stored.select("series_id", "ts_nanos", "value", F.lit(-1).cast("bigint").alias("o")).unionByName(log.select("series_id", "ts_nanos", "value", F.col("seq").alias("o")))
    return both.groupBy("series_id", "ts_nanos").agg(F.max_by("value", F.struct("o", "value")).alias("value"))
