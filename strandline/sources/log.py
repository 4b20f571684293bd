"""The durable commit log: batches of rows as Parquet, each valid once its numbered commit is there.

States: unopened, open, closed. Opening finds the last index; a batch is written whole before its commit, so a lost driver or
executor leaves no half batch; truncation follows a successful flush only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators.commitlog import QUEUE_BYTES
from strandline.sources.files import Files, Versions


class LogError(RuntimeError):
    """An operation that the log's state does not allow."""


class QueueFull(LogError):
    """More bytes are pending than the queue holds; a flush and truncation drain it."""


class CommitLog:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, queue_bytes: int = QUEUE_BYTES) -> None:
        self.spark, self.schema, self.queue_bytes = spark, schema, queue_bytes
        self.files = Files(spark, root)
        self.commits = Versions(self.files, "commits")
        self.state, self.entries, self.last = "unopened", {}, -1

    def open(self) -> int:
        """The last index, -1 for an empty log."""
        if self.state != "unopened":
            raise LogError(f"cannot open a log that is {self.state}")
        self.entries = {n: self.commits.read(n) for n in self.commits.numbers()}
        self.last = max(self.entries, default=-1)
        self.state = "open"
        return self.last

    def close(self, flush=None) -> None:
        """Runs a final flush, if one is given, and takes no further rows."""
        if self.state != "open":
            raise LogError(f"cannot close a log that is {self.state}")
        if flush is not None:
            flush()
        self.state = "closed"

    def pending(self, token: int = 0) -> int:
        """Bytes of the batches from the token on."""
        return sum(e["bytes"] for n, e in self.entries.items() if n >= token)

    def append(self, rows: DataFrame, token: int = 0, beside=None, **more) -> int:
        """Write rows as the next batch and return its index once it is durable. No rows are refused, as are rows while more than
        queue_bytes are pending from the token on. beside(batch) may give a further table to keep with the batch."""
        if self.state != "open":
            raise LogError(f"cannot write to a log that is {self.state}")
        if self.pending(token) > self.queue_bytes:
            raise QueueFull(f"{self.pending(token)} bytes are pending")
        name, seen = uuid.uuid4().hex, Observation()
        size = F.sum(F.coalesce(F.octet_length("series_id"), F.lit(0)) + 16)
        rows.select(*self.schema.fieldNames()).observe(seen, F.count(F.lit(1)).alias("rows"), size.alias("bytes")).write.option("compression", "zstd").parquet(self.files.at(f"batches/{name}"))
        got = seen.get
        if not got["rows"]:
            self.files.delete(f"batches/{name}")
            raise LogError("an empty payload")
        if beside is not None:
            beside(self.batch(name)).write.option("compression", "zstd").parquet(self.files.at(f"beside/{name}"))
        entry = {"name": name, "rows": got["rows"], "bytes": got["bytes"], **more}
        index = self.last + 1
        while not self.commits.commit(index, entry):  # another writer has it
            index += 1
        self.last = index
        self.entries[index] = entry
        return index

    def batch(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.files.at(f"batches/{name}"))

    def rows(self, token: int = 0, folder: str = "batches", schema: T.StructType | None = None) -> DataFrame:
        """Rows of the batches from the token on: one scan, however many batches there are."""
        paths = [self.files.at(f"{folder}/{e['name']}") for n, e in sorted(self.entries.items()) if n >= token]
        schema = schema or self.schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rotation_token(self) -> int:
        """The index the next batch will get."""
        return self.last + 1

    def truncate(self, token: int | None) -> None:
        """Drop the batches below the token; without a token nothing happens."""
        for n in [n for n in self.entries if token is not None and n < token]:
            self.commits.drop(n)
            for folder in ("batches", "beside"):
                self.files.delete(f"{folder}/{self.entries[n]['name']}")
            del self.entries[n]
