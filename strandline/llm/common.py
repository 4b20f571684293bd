"""Shared helpers: scratch tables, bounded training samples, Arrow batch loops."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import scratch


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def drop(*tables: DataFrame) -> None:
    """Delete the tables behind DataFrames made by cut() (or renamed by kept()), once nothing reads them any more."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_scratch", None)
        if path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def kept(df: DataFrame, source: DataFrame) -> DataFrame:
    """df, a plain selection from the table `source`, which drop(df) then deletes."""
    df._scratch = getattr(source, "_scratch", None)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_mod(id_col: str, m: int) -> Column:
    """crc32 of the id as text, mod m."""
    return F.crc32(F.col(id_col).cast("string")) % m


def class_sample(df: DataFrame, class_col: str, keys: list[str], per_class: int) -> tuple[DataFrame, list, int]:
    """Rows of each class kept with probability per_class / its count (by a hash of the keys), without a shuffle of the rows.

    Returns the rows, the class values and a hard bound on how many rows a caller may collect: 2 * per_class for each class.
    Null classes are left out; every other class is taken. Classes are label values, counted on the executors; their counts are
    all that comes to the driver."""
    counts = df.where(F.col(class_col).isNotNull()).groupBy(class_col).agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return df.where(F.lit(False)), [], 0
    rates = [min(1 << 30, int(per_class / c["n"] * (1 << 30)) + 1) for c in counts]
    rate = F.try_element_at(F.map_from_arrays(F.lit([c[0] for c in counts]), F.lit(rates)), F.col(class_col))
    kept = df.where(F.pmod(F.xxhash64(F.lit(17), *keys), F.lit(1 << 30)) < rate)
    return kept, sorted(c[0] for c in counts), 2 * per_class * len(counts)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, most_bytes: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Batches cut into parts of up to `rows` rows, and of up to most_bytes unless a row alone has more."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield from _halves(b.slice(i, rows), most_bytes)


def _halves(b: pa.RecordBatch, most_bytes: int) -> Iterator[pa.RecordBatch]:
    if b.num_rows < 2 or b.nbytes <= most_bytes:
        yield b
    else:
        yield from _halves(b.slice(0, b.num_rows // 2), most_bytes)
        yield from _halves(b.slice(b.num_rows // 2), most_bytes)


def map_texts(df: DataFrame, id_col: str, text_col: str, schema: str, make: Callable[[], Callable], rows: int = 256) -> DataFrame:
    """mapInArrow over (id, text) only, whatever other columns there are.

    make() runs once per task and returns f(ids, texts) -> dict of columns after the id; null texts arrive as ''."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in slices(batches, rows):
            texts = [t or "" for t in b.column(1).to_pylist()]
            cols = f(b.column(0).to_pylist(), texts)
            yield pa.RecordBatch.from_arrays([b.column(0), *(cols[n] if isinstance(cols[n], pa.Array) else pa.array(cols[n]) for n in names)], [ID, *names])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias(ID), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"{ID} {kind}, {schema}")
    return out.withColumnRenamed(ID, id_col)


ID = "__id"
