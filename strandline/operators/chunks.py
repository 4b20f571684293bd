"""Chunks: time blocks, the chunk index, pruning, size-targeted compaction, splitting, expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators.rank import place

TARGET_BYTES = 4096
POINT_BYTES = 16


def block_of(ts: str, block_ns: int) -> Column:
    """Number of the fixed time block of a column of nanoseconds, negative times included."""
    return F.expr(f"(`{ts}` - pmod(`{ts}`, {int(block_ns)}L)) div {int(block_ns)}L")


def chunk_index(points: DataFrame, chunk: str) -> DataFrame:
    """Per (series_id, chunk): first and last time, points, raw bytes. Pre-aggregated on the map side."""
    n = F.count(F.lit(1))
    return points.groupBy("series_id", chunk).agg(F.min("ts_nanos").alias("first_ns"), F.max("ts_nanos").alias("last_ns"), n.alias("n_points"), (n * POINT_BYTES).cast("bigint").alias("size_bytes"))


def update_index(old: DataFrame, new: DataFrame, chunk: str) -> DataFrame:
    """The index after a merge: earliest first, latest last, added counts and sizes; chunks without points are left out."""
    both = old.unionByName(new).where("n_points > 0")
    return both.groupBy("series_id", chunk).agg(F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"), F.sum("n_points").alias("n_points"), F.sum("size_bytes").alias("size_bytes"))


def prune(index: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Chunks that may hold points of [start_ns, end_ns)."""
    return index.where((F.col("last_ns") >= F.lit(start_ns)) & (F.col("first_ns") < F.lit(end_ns)))


def last_chunks(index: DataFrame) -> DataFrame:
    """(series_id, chunk_no, room): the last chunk of each series of a chunk index and the bytes it holds."""
    sizes = index.groupBy("series_id", "chunk_no").agg(F.sum("size_bytes").alias("room"))
    return sizes.groupBy("series_id").agg(F.max(F.struct("chunk_no", "room")).alias("c")).select("series_id", "c.chunk_no", "c.room")


def compact(runs: DataFrame, order: str, size: str = "size_bytes", target: int = TARGET_BYTES, last: DataFrame | None = None) -> DataFrame:
    """Adds chunk_no: flushed runs of a series, in order, go to the last chunk while its size stays within target, else to the
    next. Empty runs are left out. last: (series_id, chunk_no, room) of chunks that are there already.

    Greedy placement depends on all earlier runs of its series, so runs (not points) are sorted by series and order and folded in
    one pass that holds two numbers, whatever a series' number of runs."""
    names = runs.columns
    rows = runs.where(F.col(size) > 0).withColumns({"__chunk": F.lit(None).cast("bigint"), "__room": F.lit(None).cast("bigint")})
    if last is not None:
        held = last.select("series_id", F.col("chunk_no").alias("__chunk"), F.col("room").cast("bigint").alias("__room"))
        rows = rows.unionByName(held.join(runs.select("series_id").distinct(), "series_id", "left_semi"), allowMissingColumns=True)
    schema = T.StructType([*runs.schema.fields, T.StructField("chunk_no", T.LongType())])
    fields = [*names, "__chunk", "__room"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, chunk, room = None, -1, 0
        for b in batches:
            col = dict(zip(fields, b.columns, strict=True))
            own = []
            for s, n, c, r in zip(col["series_id"].to_pylist(), col[size].to_pylist(), col["__chunk"].to_pylist(), col["__room"].to_pylist(), strict=True):
                if s != series:
                    series, chunk, room = s, -1, 0
                if c is not None:
                    chunk, room = c, r
                elif chunk >= 0 and room + n <= target:
                    room += n
                else:
                    chunk, room = chunk + 1, n
                own.append(None if c is not None else chunk)
            placed = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays([*(col[n] for n in names), placed], [*names, "chunk_no"]).filter(placed.is_valid())

    sorted_ = rows.select(*fields).repartition("series_id").sortWithinPartitions("series_id", F.col("__chunk").asc_nulls_last(), order)
    return sorted_.mapInArrow(fold, schema)


def split_large(points: DataFrame, most_points: int, order: str = "ts_nanos", block: int | None = None) -> DataFrame:
    """Adds part: points of a series in `order`, cut after every most_points. block: as in rank.place, for hot series."""
    return place(points, ["series_id"], [order], block, "__place").withColumn("part", F.floor((F.col("__place") - 1) / most_points).cast("bigint")).drop("__place")


def expire(rows: DataFrame, ttl_ns: int, now_ns: int | None = None, last: str = "ts_nanos") -> DataFrame:
    """Rows (points, or chunks by their last time) that are not older than ttl_ns; now is the latest time unless given."""
    if now_ns is not None:
        return rows.where(F.col(last) >= F.lit(now_ns - ttl_ns))
    now = rows.agg(F.max(last).alias("__now"))  # one row
    return rows.crossJoin(F.broadcast(now)).where(F.col(last) >= F.col("__now") - F.lit(ttl_ns)).drop("__now")
