"""One interface over three write policies: write, write_batch, flush, read, read_batch, read_range, close.

raw upserts; direct-compress appends to one compressed stream a series and keeps arrival order; raw-block admits strictly ordered
points per flush interval and merges them by time at read. A batch is in the commit log before its write returns, so points are
durable and visible from then on; opening an engine on a folder finds the log and goes on from it. A flush moves what the log holds
into the store, as a part of its own, and truncates the log only after the store's new version is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators import ingest, read
from strandline.sources.log import CommitLog, LogError
from strandline.sources.model import WRITE
from strandline.sources.store import Store
from strandline.sources.streams import Streams

ENGINES = ("raw", "direct-compress", "raw-block")
LOGGED = T.StructType([*WRITE.fields, T.StructField("status", T.StringType())])
LAST = T.StructType([T.StructField("series_id", T.StringType()), T.StructField("last_ns", T.LongType())])
ARRIVALS = 40  # bits of a batch's own arrival numbers; the batch's index stands above them
STORED = 1 << 60  # below all arrivals of the log: the places of a stored stream


def upserted(points: DataFrame) -> DataFrame:
    """The last write of each time of a series."""
    last = F.max_by(F.struct("value", "arrival"), F.struct("arrival", "value"))
    return points.groupBy("series_id", "ts_nanos").agg(last.alias("l")).select("series_id", "ts_nanos", "l.value", "l.arrival")


class Engine:
    def __init__(self, spark: SparkSession, root: str, engine: str = "raw-block", block_ns: int = 86_400 * 10**9, queue_bytes: int = 1 << 36, target: int = 4096) -> None:
        if engine not in ENGINES:
            raise ValueError(f"unknown engine {engine!r}: one of {', '.join(ENGINES)}")
        self.spark, self.engine, root = spark, engine, root.rstrip("/")
        self.store = Streams(spark, f"{root}/streams") if engine == "direct-compress" else Store(spark, f"{root}/store", block_ns, WRITE, upserted if engine == "raw" else None, target)
        self.log = CommitLog(spark, f"{root}/log", LOGGED, queue_bytes)
        self.log.open()
        known = self.store.manifest()
        self.token, self.done = known.get("token", 0), known.get("done", {})
        # An emptied log must not give out indices again that the store has seen.
        self.log.last = max(self.log.last, self.token - 1)
        for e in self.log.entries.values():
            if e.get("stream"):
                self.done[e["stream"]] = max(self.done.get(e["stream"], -1), e["batch"])

    def write(self, series_id: str | None, ts_nanos: int | None, value: float | None) -> DataFrame:
        return self.write_batch(self.spark.createDataFrame([(series_id, ts_nanos, value, 0)], WRITE))

    def write_batch(self, points: DataFrame, stream: str | None = None, batch: int = 0) -> DataFrame:
        """Log points (series_id, ts_nanos, value, arrival from 0 up to 2**40 in a batch). Returns each with its status, read from
        the log: OK, OUT_OF_ORDER, DUPLICATE, or INVALID without an id, a time or a value; only OK points are stored, and the
        rest of a batch is not affected. Statuses can be read until the flush after next. A batch of no points changes nothing,
        nor does a numbered batch of a stream that was logged before. A full log is flushed first."""
        if stream is not None and self.done.get(stream, -1) >= batch:
            return self.spark.createDataFrame([], LOGGED)
        if self.log.state == "open" and self.log.pending(self.token) > self.log.queue_bytes:
            self.flush()
        absent = (1 << ARRIVALS) - 1 if self.engine == "direct-compress" else 0  # there a point without an arrival is its batch's last
        rows = points.select("series_id", "ts_nanos", "value", (F.lit((self.log.rotation_token() + 1) << ARRIVALS) + F.coalesce("arrival", F.lit(absent))).alias("arrival"))
        fine = F.col("series_id").isNotNull() & F.col("ts_nanos").isNotNull() & F.col("value").isNotNull()
        if self.engine == "raw-block":
            last = self.log.rows(self.token, "beside", LAST).groupBy("series_id").agg(F.max("last_ns").alias("last_ns"))
            judged = ingest.admit(rows.where(fine), block=1 << 20, after=last)
            judged = judged.unionByName(rows.where(~fine).withColumn("status", F.lit(ingest.INVALID)))
        else:
            judged = rows.withColumn("status", F.when(fine, ingest.OK).otherwise(ingest.INVALID))
        newest = lambda b: b.where(F.col("status") == ingest.OK).groupBy("series_id").agg(F.max("ts_nanos").alias("last_ns"))
        try:
            index = self.log.append(judged, self.token, newest if self.engine == "raw-block" else None, **({"stream": stream, "batch": batch} if stream else {}))
        except LogError:
            if self.log.state == "open" and points.isEmpty():
                return self.spark.createDataFrame([], LOGGED)
            raise
        if stream is not None:
            self.done[stream] = batch
        return self.log.batch(self.log.entries[index]["name"])

    def buffer(self, ids: list[str] | None = None) -> DataFrame:
        """Logged points that are not in the store yet."""
        rows = self.log.rows(self.token).where(F.col("status") == ingest.OK).drop("status")
        return rows if ids is None else rows.where(F.col("series_id").isin(list(ids)))

    def flush(self) -> int:
        """Move the logged points into the store and return its version; without any the version stays. The next batch starts a
        new interval: ordered admission forgets the times before. What the flush before took is dropped from the log."""
        token, new = self.log.rotation_token(), self.buffer()
        if token == self.token or new.isEmpty():
            return self.store.version()
        facts = {"token": token, "done": self.done}
        version = self.store.append(upserted(new), new, **facts) if self.engine == "raw" else self.store.append(new, **facts)
        self.log.truncate(self.token)
        self.token = token
        if self.engine != "direct-compress":
            self.store.drop_before(version - 8)  # readers of the last versions go on
        return version

    def close(self) -> None:
        """A final flush; further writes are refused, a second close is an error."""
        self.log.close(self.flush)

    def points(self, start_ns: int | None = None, end_ns: int | None = None, ids: list[str] | None = None) -> DataFrame:
        """All visible points (series_id, ts_nanos, value, arrival), of a range and some series if asked for. raw keeps the last
        write of a time; the others keep all."""
        stored = self.store.points(start_ns, end_ns, ids)
        if self.engine == "direct-compress":
            stored = stored.select("series_id", "ts_nanos", "value", (F.col("place") - F.lit(STORED)).alias("arrival"))
        new = self.buffer(ids)
        if start_ns is not None:
            new = new.where(F.col("ts_nanos") >= F.lit(start_ns))
        if end_ns is not None:
            new = new.where(F.col("ts_nanos") < F.lit(end_ns))
        every = read.merged(stored, new)
        return upserted(every) if self.engine == "raw" else every

    def read(self, series_id: str, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
        """The series in time order (direct-compress: in arrival order, equal arrivals by time, then value); no rows if it is unknown."""
        rows = self.points(start_ns, end_ns, [series_id])
        return rows.orderBy("arrival", "ts_nanos", "value") if self.engine == "direct-compress" else rows.orderBy("ts_nanos", "arrival")

    def read_batch(self, ids: list[str]) -> DataFrame:
        """One row per wanted id with its datapoints in time order."""
        return read.responses(self.points(ids=ids), self.spark.createDataFrame([(i,) for i in ids], "series_id string"))

    def read_range(self, series_id: str, start_ns: int, end_ns: int) -> DataFrame:
        return self.read(series_id, start_ns, end_ns)
