"""Compressed streams: each flush continues a series' stream from its saved codec state, as segments that decode on their own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import codec
from strandline.sources.files import Files, Versions

SEGMENT = "series_id string, part bigint, data binary, n_points bigint, nulls binary, before string, state string"
STATE = "series_id string, part bigint, state string"


class Streams:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.files = spark, Files(spark, root)
        self.manifests = Versions(self.files, "manifest")

    def version(self) -> int:
        return max(self.manifests.numbers(), default=-1)

    def manifest(self) -> dict:
        v = self.version()
        return self.manifests.read(v) if v >= 0 else {"parts": [], "states": None}

    def segments(self) -> DataFrame:
        """Segments of all flushes; those of a series in `part` order are its stream."""
        parts = self.manifest()["parts"]
        return self.spark.read.schema(SEGMENT).parquet(*[self.files.at(f"segments/{p}") for p in parts]) if parts else self.spark.createDataFrame([], SEGMENT)

    def states(self) -> DataFrame:
        """The last state of each series: what the next flush goes on from."""
        name = self.manifest()["states"]
        return self.spark.read.schema(STATE).parquet(self.files.at(f"states/{name}")) if name else self.spark.createDataFrame([], STATE)

    def append(self, points: DataFrame, **more) -> int:
        """Encode points (series_id, ts_nanos, value, arrival) in arrival order after what their series hold."""
        old, v, name = self.manifest(), self.version(), uuid.uuid4().hex[:16]
        made = codec.encode_from(points, self.states())
        made.sortWithinPartitions("series_id", "part").write.option("compression", "zstd").parquet(self.files.at(f"segments/{name}"))
        new = self.spark.read.schema(SEGMENT).parquet(self.files.at(f"segments/{name}")).select("series_id", "part", "state")
        latest = self.states().unionByName(new).groupBy("series_id").agg(F.max(F.struct("part", "state")).alias("s")).select("series_id", "s.part", "s.state")
        latest.write.option("compression", "zstd").parquet(self.files.at(f"states/{name}"))
        if not self.manifests.commit(v + 1, {**old, **more, "parts": [*old["parts"], name], "states": name}):
            raise RuntimeError(f"another writer published version {v + 1}")
        if old["states"]:
            self.files.delete(f"states/{old['states']}")
        return v + 1

    def points(self, start_ns: int | None = None, end_ns: int | None = None, ids: list[str] | None = None) -> DataFrame:
        """Stored points with their place in the series' order of arrival; an id filter reaches the scan of the segments."""
        segments = self.segments()
        if ids is not None:
            segments = segments.where(F.col("series_id").isin(list(ids)))
        rows = codec.decode(segments)
        if start_ns is not None:
            rows = rows.where(F.col("ts_nanos") >= F.lit(start_ns))
        return rows if end_ns is None else rows.where(F.col("ts_nanos") < F.lit(end_ns))
