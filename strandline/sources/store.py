"""The chunk store on Parquet: time-blocked parts, clustered by series and time, published by version.

A part is a folder of points and a chunk index, written once. A version is a manifest that lists the live parts, so readers see
data and index of one state. A flush adds a part of its own points; parts of like size are merged now and then, so all rewriting
together is of the order of n log n. Writes are v2 pages with zstd, where timestamps get delta encoding."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators import chunks
from strandline.sources.files import Files, Versions
from strandline.sources.model import POINT

BLOCK_NS = 2 * 3600 * 1_000_000_000
SLICE_POINTS = 1 << 17  # of a block that are dealt together, about
FAN = 4  # parts of one size class that are merged into one
RUN = ["series_id", "block", "chunk_no", "first_ns", "last_ns", "n_points", "size_bytes"]
INDEX = T.StructType([T.StructField("series_id", T.StringType()), *[T.StructField(c, T.LongType()) for c in RUN[1:]], T.StructField("part", T.StringType())])


def write_points(points: DataFrame, path: str, block_ns: int = BLOCK_NS, mode: str = "errorifexists", sized_by: DataFrame | None = None) -> None:
    """Points partitioned by time block, dealt by block and slice, sorted within files by (block, series, time).

    Blocks are counted first, which takes the times alone; one of n points has n / SLICE_POINTS slices, to which a hash of the
    series and of the 64th of the block deals them, so neither a busy block nor a busy series is one task's, and a block of few
    points is one file; slices of a block that meet in a task share a file. There is no partition for each series, of which there
    may be millions. sized_by: rows to count instead, no fewer in any block, where those are cheaper to have."""
    counts = (points if sized_by is None else sized_by).groupBy(chunks.block_of("ts_nanos", block_ns).alias("block")).agg(F.ceil(F.count(F.lit(1)) / SLICE_POINTS).alias("__slices"))
    rows = points.withColumn("block", chunks.block_of("ts_nanos", block_ns)).join(counts, "block")
    dealt = F.pmod(F.xxhash64("series_id", chunks.block_of("ts_nanos", max(1, block_ns // 64))), F.col("__slices"))
    # A fixed number of partitions: small ones are not joined, as a task's time goes by its files too.
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "block", dealt).drop("__slices").sortWithinPartitions("block", "series_id", "ts_nanos")
    rows.write.mode(mode).partitionBy("block").option("compression", "zstd").option("parquet.writer.version", "v2").parquet(path)


def read_points(spark: SparkSession, path: str, start_ns: int | None = None, end_ns: int | None = None, block_ns: int = BLOCK_NS) -> DataFrame:
    """Stored points; a time range prunes block directories and reaches the files as a filter."""
    return _between(spark.read.parquet(path), start_ns, end_ns, block_ns)


def _between(rows: DataFrame, start_ns: int | None, end_ns: int | None, block_ns: int) -> DataFrame:
    if start_ns is not None:
        rows = rows.where((F.col("block") >= start_ns // block_ns) & (F.col("ts_nanos") >= F.lit(start_ns)))
    if end_ns is not None:
        rows = rows.where((F.col("block") <= (end_ns - 1) // block_ns) & (F.col("ts_nanos") < F.lit(end_ns)))
    return rows


class Store:
    """Versions under one root. `merge` says what a merge of parts does to their points (by default it keeps them all)."""

    def __init__(self, spark: SparkSession, root: str, block_ns: int = BLOCK_NS, schema: T.StructType = POINT, merge: Callable[[DataFrame], DataFrame] | None = None, target: int = chunks.TARGET_BYTES) -> None:
        self.spark, self.block_ns, self.schema, self.merged, self.target = spark, block_ns, schema, merge, target
        self.files = Files(spark, root)
        self.manifests = Versions(self.files, "manifest")

    def version(self) -> int:
        """The largest published version, -1 if there is none."""
        return max(self.manifests.numbers(), default=-1)

    def manifest(self) -> dict:
        v = self.version()
        return self.manifests.read(v) if v >= 0 else {"parts": []}

    def publish(self, points: DataFrame) -> int:
        """Points (not read from parts that are dropped meanwhile) in place of all that is stored."""
        old = self.manifest()
        return self._commit({**old, "parts": [self._write(points, [])]}, self.version())

    def append(self, points: DataFrame, sized_by: DataFrame | None = None, **more) -> int:
        """Points beside what is stored, as a part of their own, and further facts of the manifest; then parts that have become
        FAN of a size are merged. Nothing that is stored is read but the index."""
        old, v = self.manifest(), self.version()
        v = self._commit({**old, **more, "parts": [*old["parts"], self._write(points, old["parts"], sized_by=sized_by)]}, v)
        while (full := self._full_class()) is not None:
            old = self.manifest()
            rest = [p for p in old["parts"] if p not in full]
            points = self._points(full).drop("block")
            numbers = self._index(full).groupBy("series_id", "block").agg(F.min("chunk_no").alias("chunk_no"))
            v = self._commit({**old, "parts": [*rest, self._write(self.merged(points) if self.merged else points, rest, numbers, points)]}, v)
        return v

    def _full_class(self) -> list[dict] | None:
        classes: dict[int, list[dict]] = {}
        for p in self.manifest()["parts"]:
            classes.setdefault(int(math.log(max(p["points"], 1), FAN)), []).append(p)
        return next((c for _, c in sorted(classes.items()) if len(c) >= FAN), None)

    def _commit(self, content: dict, over: int) -> int:
        if not self.manifests.commit(over + 1, content):
            raise RuntimeError(f"another writer published version {over + 1}")
        return over + 1

    def _write(self, points: DataFrame, beside: list[dict], numbers: DataFrame | None = None, sized_by: DataFrame | None = None) -> dict:
        """A new part: points, then their runs (series and block) with the chunk each run goes to: the last one of its series
        while that stays within the target, else the next (or, of merged parts, the one it had)."""
        name = uuid.uuid4().hex[:16]
        write_points(points.select(*self.schema.fieldNames()), self.files.at(f"points/part={name}"), self.block_ns, sized_by=sized_by)
        runs = chunks.chunk_index(self._points([{"name": name}]), "block")
        if numbers is not None:
            placed = runs.join(numbers, ["series_id", "block"], "left")
        else:
            placed = chunks.compact(runs, "block", target=self.target, last=chunks.last_chunks(self._index(beside)) if beside else None)
        placed = placed.select(*RUN).hint("rebalance", F.col("series_id")).sortWithinPartitions("series_id", "block")
        placed.write.option("compression", "zstd").parquet(self.files.at(f"index/part={name}"))
        n = self._index([{"name": name}]).agg(F.coalesce(F.sum("n_points"), F.lit(0))).first()[0]
        return {"name": name, "points": int(n)}

    def _read(self, folder: str, schema: T.StructType, folders: list[str]) -> DataFrame:
        """Rows of some folders below `folder`, named by partition columns: one scan, however many parts there are."""
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.files.at(folder)).parquet(*[self.files.at(f"{folder}/{x}") for x in folders])

    def _points(self, parts: list[dict]) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("part", T.StringType()), T.StructField("block", T.LongType())])
        return self._read("points", schema, [f"part={p['name']}" for p in parts]).drop("part")

    def _index(self, parts: list[dict]) -> DataFrame:
        return self._read("index", INDEX, [f"part={p['name']}" for p in parts])

    def points(self, start_ns: int | None = None, end_ns: int | None = None, ids: list[str] | None = None) -> DataFrame:
        """Stored points of a range and of some series. With ids the chunk index says which blocks of which parts hold any, and
        no other file is opened; those pairs (not points) come to the driver."""
        parts = self.manifest()["parts"]
        if ids is None or not parts:
            return _between(self._points(parts), start_ns, end_ns, self.block_ns).drop("block")
        found = self._index(parts).where(F.col("series_id").isin(list(ids)))
        if start_ns is not None:
            found = found.where(F.col("last_ns") >= F.lit(start_ns))
        if end_ns is not None:
            found = found.where(F.col("first_ns") < F.lit(end_ns))
        rows = self._read("points", self.schema, [f"part={r['part']}/block={r['block']}" for r in found.select("part", "block").distinct().collect()])
        rows = rows.select(*self.schema.fieldNames()).where(F.col("series_id").isin(list(ids)))
        if start_ns is not None:
            rows = rows.where(F.col("ts_nanos") >= F.lit(start_ns))
        return rows if end_ns is None else rows.where(F.col("ts_nanos") < F.lit(end_ns))

    def runs(self) -> DataFrame:
        """The chunk index: one row for each run of a series in a block of a part, with its chunk."""
        return self._index(self.manifest()["parts"]).select(*RUN, "part")

    def index(self) -> DataFrame:
        """The runs of all parts taken together by series and block."""
        runs = self.runs()
        return chunks.update_index(runs.drop("chunk_no", "part").where("false"), runs.drop("chunk_no", "part"), "block")

    def drop_before(self, version: int) -> None:
        """Remove manifests below `version` and parts that no later one lists; the caller knows that nobody reads them."""
        live = {p["name"] for v in self.manifests.numbers() if v >= version for p in self.manifests.read(v)["parts"]}
        for v in [v for v in self.manifests.numbers() if v < version]:
            for p in self.manifests.read(v)["parts"]:
                if p["name"] not in live:
                    self.files.delete(f"index/part={p['name']}")
                    self.files.delete(f"points/part={p['name']}")
            self.manifests.drop(v)
