"""The JSON wire format: write requests in, read responses out."""

from __future__ import annotations

import json
import math
import threading
from collections.abc import Callable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The field names of the wire messages.
WRITE_BATCH = "struct<batch:array<struct<series_id:string,datapoint:struct<timestamp_nanos:decimal(20,0),value:double>>>>"
READ_BATCH = "struct<batch:array<struct<series_id:string>>>"

PATHS = {"write": "/api/v1/writeBatch", "read": "/api/v1/readBatch"}


def parse_writes(bodies: DataFrame, body: str = "value") -> DataFrame:
    """Points of write requests, one JSON body a row: series_id, ts_nanos, value and arrival (their place in the batch).

    Times are unsigned on the wire; from 2**63 on there is no LONG for them and ts_nanos is null, as in malformed bodies."""
    batch = F.from_json(F.col(body), WRITE_BATCH)["batch"]
    w = bodies.select(F.posexplode(batch).alias("arrival", "w"))
    ts = F.col("w.datapoint.timestamp_nanos")
    ts = F.when((ts >= 0) & (ts < F.lit("9223372036854775808").cast("decimal(20,0)")), ts.cast("bigint"))
    return w.select(F.col("w.series_id").alias("series_id"), ts.alias("ts_nanos"), F.col("w.datapoint.value").alias("value"), F.col("arrival").cast("bigint").alias("arrival"))


def parse_reads(bodies: DataFrame, body: str = "value") -> DataFrame:
    batch = F.from_json(F.col(body), READ_BATCH)["batch"]
    return bodies.select(F.explode(batch).alias("r")).select("r.series_id")


def write_requests(points: DataFrame, most: int = 128, order: str = "arrival") -> DataFrame:
    """Bodies of write requests of up to `most` points of neighbouring order values."""
    point = F.struct("series_id", F.struct(F.col("ts_nanos").alias("timestamp_nanos"), "value").alias("datapoint"))
    grouped = points.groupBy(F.floor(F.col(order) / most).alias("request"))
    batch = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), point.alias("p")))), lambda x: x["p"])
    return grouped.agg(F.to_json(F.struct(batch.alias("batch"))).alias("value"))


def read_responses(responses: DataFrame) -> DataFrame:
    """One JSON line per wanted series, as in the batch of a read response."""
    points = F.transform("datapoints", lambda d: F.struct(d["ts_nanos"].alias("timestamp_nanos"), d["value"].alias("value")))
    return responses.select("series_id", F.to_json(F.struct("series_id", points.alias("datapoints"))).alias("value"))


def answer(points: DataFrame, ids: list[str]) -> Iterator[str]:
    """Pieces of the answer to a read request: every wanted id once, in order, with its datapoints in time order. Points come to
    the caller a partition at a time, so an answer of any length is never held whole. As JSON has no such numbers, NaN and the
    infinities are strings, which parse_writes reads back."""
    left = iter(sorted(set(ids)))
    opened, comma = None, ""
    yield '{"batch":['
    for r in points.where(F.col("series_id").isin(list(ids))).select("series_id", "ts_nanos", "value").orderBy("series_id", "ts_nanos", *[c for c in ("arrival",) if c in points.columns]).toLocalIterator():
        if r["series_id"] != opened:
            if opened is not None:
                yield "]}"
            for i in left:  # ids come in the same order: those before this one have no points
                yield f'{comma}{{"series_id":{json.dumps(i)},"datapoints":['
                comma = ","
                if i == r["series_id"]:
                    break
                yield "]}"
            opened, between = r["series_id"], ""
        v = r["value"]
        yield f'{between}{{"timestamp_nanos":{r["ts_nanos"]},"value":{json.dumps(v) if math.isfinite(v) else json.dumps("NaN" if math.isnan(v) else "Infinity" if v > 0 else "-Infinity")}}}'
        between = ","
    if opened is not None:
        yield "]}"
    for i in left:
        yield f'{comma}{{"series_id":{json.dumps(i)},"datapoints":[]}}'
        comma = ","
    yield "]}"


def _entries(body: str, wanted: Callable[[dict], bool]) -> list[dict] | None:
    """The batch of a request's body; None if the body is malformed."""
    try:
        request = json.loads(body)
    except ValueError:
        return None
    batch = request.get("batch", []) if isinstance(request, dict) else None
    return batch if isinstance(batch, list) and all(isinstance(x, dict) and wanted(x) for x in batch) else None


def _is_write(x: dict) -> bool:
    point = x.get("datapoint")
    if not isinstance(x.get("series_id"), str) or not isinstance(point, dict):
        return False
    ts, value = point.get("timestamp_nanos", 0), point.get("value", 0)
    number = isinstance(value, (int, float)) and not isinstance(value, bool) or value in ("NaN", "Infinity", "-Infinity")
    return number and not isinstance(ts, bool) and (isinstance(ts, int) and ts >= 0 or isinstance(ts, str) and ts.isdigit())


def serve(spark: SparkSession, engine, path: str, body: str) -> tuple[int, Iterator[str]]:
    """Answer one request: HTTP status and the pieces of the body. Malformed bodies are 400, other paths 404. A write answers once
    its points are in the engine's log."""
    if path == PATHS["write"]:
        if _entries(body, _is_write) is None:
            return 400, iter(["{}"])
        engine.write_batch(parse_writes(spark.createDataFrame([(body,)], "value string")))
        return 200, iter(["{}"])
    if path == PATHS["read"]:
        batch = _entries(body, lambda x: isinstance(x.get("series_id"), str))
        if batch is None:
            return 400, iter(["{}"])
        ids = [x["series_id"] for x in batch]
        return 200, answer(engine.points(ids=ids), ids)
    return 404, iter(["{}"])


def listen(spark: SparkSession, engine, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """An HTTP server for the two paths on a thread of its own; shutdown() ends it, server_port tells its port. Writes take turns,
    as the engine is one writer; answers are sent in chunks as they come."""
    turn = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8", "replace")
            with turn:
                status, pieces = serve(spark, engine, self.path, body)
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Transfer-Encoding", "chunked")
            self.end_headers()
            for piece in pieces:
                data = piece.encode()
                self.wfile.write(b"%x\r\n%s\r\n" % (len(data), data))
            self.wfile.write(b"0\r\n\r\n")

        def log_message(self, *_) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
