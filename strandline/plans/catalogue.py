"""The registered queries of the engine's own operators, each with its DuckDB twin."""

from __future__ import annotations

import functools
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import codec
from strandline.operators import chunks, commitlog, ingest, merge, read, tags
from strandline.plans.engine import Engine
from strandline.session import scratch
from strandline.sources import generator, wire
from strandline.sources.model import customer_tags, event_points, hourly_points, nanos, order_points
from strandline.sources.store import Store, read_points, write_points
from strandline.streaming import ingest as streaming

NS = 1_000_000_000
DAY = 86_400 * NS
FROM, TO = 1_704_844_800 * NS, 1_705_017_600 * NS  # 2024-01-10 and 2024-01-12
TARGET = 512
WEEK = 7 * DAY

#: Views shared by the twins: dp, hr and ord as in sources.model.
DP = """dp AS (SELECT CAST(user_id AS VARCHAR) AS series_id, epoch_us(ts) * 1000 AS ts_nanos, value, event_id AS seq,
  event_type AS stream, (event_id * 7919) % 1000003 AS arrival, CAST(ts AS DATE) AS epoch FROM events)"""
HR = "hr AS (SELECT event_type AS series_id, epoch_us(date_trunc('hour', ts)) * 1000 AS ts_nanos, value, event_id AS seq FROM events)"
ORD = "ord AS (SELECT CAST(o_custkey AS VARCHAR) AS series_id, epoch_us(o_orderdate) * 1000 AS ts_nanos, o_totalprice AS value, o_orderkey AS arrival FROM orders)"
TAGS = "tags AS (SELECT CAST(c_custkey AS VARCHAR) AS series_id, c_mktsegment AS seg, c_nationkey AS nat FROM customer)"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series over two runs: points of earlier epochs are stored chunks, the last epoch is the unflushed buffer."""
    dp = event_points(spark, sf_dir)
    cut = F.lit(FROM)
    return read.series_read(read.merged(dp.where(F.col("ts_nanos") < cut), dp.where(F.col("ts_nanos") >= cut)), "8").select("series_id", "ts_nanos", "value")


@query(f"WITH {DP} SELECT series_id, ts_nanos, value FROM dp WHERE series_id = '8'")
def series_read(spark, sf_dir):
    return entry(spark, sf_dir)


@query(f"WITH {DP} SELECT series_id, ts_nanos, value FROM dp WHERE series_id IN ('8', '46', '101', 'no-such')")
def read_batch(spark, sf_dir):
    return read.read_batch(event_points(spark, sf_dir), ["8", "46", "101", "no-such"]).select("series_id", "ts_nanos", "value")


@query("""SELECT series_id, CAST(ts_nanos AS BIGINT) AS ts_nanos, CAST(value AS DOUBLE) AS value, status
FROM (VALUES ('a', 20, 1.5, 'OK'), ('a', 10, 2.5, 'OUT_OF_ORDER'), ('a', 20, 3.5, 'DUPLICATE'), ('b', 10, NULL, 'INVALID'), ('b', 10, 4.5, 'OK')) t(series_id, ts_nanos, value, status)""")
def engine_write(spark, sf_dir):
    """Single writes, one after the other, each with the answer it gets."""
    engine = Engine(spark, scratch(spark, "write"), "raw-block")
    answers = [engine.write(*w) for w in [("a", 20, 1.5), ("a", 10, 2.5), ("a", 20, 3.5), ("b", 10, None), ("b", 10, 4.5)]]
    return functools.reduce(DataFrame.unionByName, answers).select("series_id", "ts_nanos", "value", "status")


@query(f"WITH {DP} SELECT series_id, ts_nanos, arg_max(value, seq) AS value FROM dp WHERE series_id = '46' GROUP BY 1, 2")
def gateway_write(spark, sf_dir):
    """A series posted as the gateway takes it, in one write request, and what the engine then holds."""
    engine = Engine(spark, scratch(spark, "gateway"), "raw")
    for r in wire.write_requests(event_points(spark, sf_dir).where("series_id = '46'"), 1 << 40, "seq").toLocalIterator():
        wire.serve(spark, engine, wire.PATHS["write"], r["value"])
    return engine.points().select("series_id", "ts_nanos", "value")


@query(f"""WITH {DP}, ids AS (SELECT unnest(['8', '46', '101', 'no-such']) AS series_id)
SELECT i.series_id, CAST(count(d.ts_nanos) AS BIGINT) AS n_points, min(d.ts_nanos) AS first_ns, max(d.ts_nanos) AS last_ns FROM ids i LEFT JOIN dp d ON i.series_id = d.series_id GROUP BY 1""")
def read_responses(spark, sf_dir):
    """Every wanted id has an answer, unknown ones an empty one; the answers go through the JSON wire form."""
    ids = spark.createDataFrame([(i,) for i in ("8", "46", "101", "no-such")], "series_id string")
    lines = wire.read_responses(read.responses(read.read_batch(event_points(spark, sf_dir), ids), ids))
    got = F.from_json("value", "series_id string, datapoints array<struct<timestamp_nanos:bigint,value:double>>")
    times = F.transform(got["datapoints"], lambda d: d["timestamp_nanos"])
    return lines.select(got["series_id"].alias("series_id"), F.size(times).cast("bigint").alias("n_points"), F.array_min(times).alias("first_ns"), F.array_max(times).alias("last_ns"))


@query(f"WITH {HR} SELECT series_id, ts_nanos, arg_max(value, seq) AS value FROM hr GROUP BY 1, 2")
def upsert_lww(spark, sf_dir):
    return ingest.upsert(hourly_points(spark, sf_dir))


@query(f"WITH {HR}, s AS (SELECT *, seq % 2 AS half FROM hr) SELECT series_id, ts_nanos, arg_max(value, half * 10000000000 + seq) AS value FROM s GROUP BY 1, 2")
def upsert_stored(spark, sf_dir):
    """Odd events written over the state that the even ones left."""
    hr = hourly_points(spark, sf_dir)
    stored = ingest.upsert(hr.where("seq % 2 = 0"))
    return ingest.upsert(hr.where("seq % 2 = 1"), stored=stored)


@query(f"WITH {DP} SELECT series_id, ts_nanos, value, CAST(row_number() OVER (PARTITION BY series_id ORDER BY arrival) AS BIGINT) AS place FROM dp")
def append_arrival(spark, sf_dir):
    return ingest.append(event_points(spark, sf_dir)).select("series_id", "ts_nanos", "value", "place")


@query(f"WITH {DP} SELECT series_id, ts_nanos, value, CAST(row_number() OVER (PARTITION BY series_id ORDER BY arrival) AS BIGINT) AS place FROM dp")
def append_arrival_blocked(spark, sf_dir):
    """The same by runs of arrival, as for a hot series."""
    return ingest.append(event_points(spark, sf_dir), block=100_000).select("series_id", "ts_nanos", "value", "place")


def _admit_sql(view: str, keys: str, order: str, status: str) -> str:
    return f"""WITH {dict(dp=DP, hr=HR, ord=ORD)[view]}, a AS (SELECT *, max(ts_nanos) OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {view})
SELECT series_id, ts_nanos, value{status}"""


_OK = " FROM a WHERE before IS NULL OR ts_nanos > before"


@query(_admit_sql("dp", "series_id", "arrival", _OK))
def admit_ok(spark, sf_dir):
    return ingest.admit(event_points(spark, sf_dir)).where("status = 'OK'").select("series_id", "ts_nanos", "value")


@query(_admit_sql("dp", "series_id", "arrival", _OK))
def admit_ok_blocked(spark, sf_dir):
    """The same by runs of arrival, as for a hot series."""
    return ingest.admit(event_points(spark, sf_dir), block=100_000).where("status = 'OK'").select("series_id", "ts_nanos", "value")


@query(_admit_sql("dp", "series_id, epoch", "arrival", _OK))
def admit_ok_epoch(spark, sf_dir):
    return ingest.admit(event_points(spark, sf_dir), epoch="epoch").where("status = 'OK'").select("series_id", "ts_nanos", "value")


@query(_admit_sql("hr", "series_id", "seq", " FROM a WHERE ts_nanos = before"))
def admit_dup(spark, sf_dir):
    return ingest.admit(hourly_points(spark, sf_dir), order="seq").where("status = 'DUPLICATE'").select("series_id", "ts_nanos", "value")


@query(_admit_sql("ord", "series_id", "arrival", ", CASE WHEN before IS NULL OR ts_nanos > before THEN 'OK' WHEN ts_nanos = before THEN 'DUPLICATE' ELSE 'OUT_OF_ORDER' END AS status FROM a"))
def admit_orders(spark, sf_dir):
    return ingest.admit(order_points(spark, sf_dir)).select("series_id", "ts_nanos", "value", "status")


@query(f"WITH {DP} SELECT series_id, ts_nanos, stream, value, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts_nanos, stream, value) AS BIGINT) AS place FROM dp")
def kway_merge(spark, sf_dir):
    return merge.kway_merge(event_points(spark, sf_dir)).select("series_id", "ts_nanos", "stream", "value", "place")


@query(f"WITH {DP} SELECT series_id, ts_nanos, stream, value, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts_nanos, stream, value) AS BIGINT) AS place FROM dp")
def kway_merge_blocked(spark, sf_dir):
    return merge.kway_merge(event_points(spark, sf_dir), block=DAY).select("series_id", "ts_nanos", "stream", "value", "place")


_RUNS = f"""WITH {DP}, b AS (SELECT *, CASE WHEN ts_nanos <= lag(ts_nanos) OVER (PARTITION BY series_id ORDER BY arrival) THEN 1 ELSE 0 END AS broke FROM dp)
SELECT series_id, ts_nanos, value, CAST(sum(broke) OVER (PARTITION BY series_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run FROM b"""


@query(_RUNS)
def run_split(spark, sf_dir):
    return merge.run_split(event_points(spark, sf_dir)).select("series_id", "ts_nanos", "value", F.col("run").cast("bigint").alias("run"))


@query(_RUNS)
def run_split_blocked(spark, sf_dir):
    return merge.run_split(event_points(spark, sf_dir), block=100_000).select("series_id", "ts_nanos", "value", F.col("run").cast("bigint").alias("run"))


@query(f"WITH {DP} SELECT series_id, arg_max(ts_nanos, arrival) AS ts_nanos, arg_max(value, arrival) AS value FROM dp GROUP BY 1")
def last_encoded(spark, sf_dir):
    return ingest.last_encoded(event_points(spark, sf_dir))


_INDEX = "SELECT series_id, epoch, min(ts_nanos) AS first_ns, max(ts_nanos) AS last_ns, count(*) AS n_points, CAST(16 * count(*) AS BIGINT) AS size_bytes FROM dp GROUP BY 1, 2"


@query(f"WITH {DP} {_INDEX}")
def chunk_index(spark, sf_dir):
    return chunks.chunk_index(event_points(spark, sf_dir), "epoch")


@query(f"WITH {DP} {_INDEX}")
def chunk_index_updated(spark, sf_dir):
    """The index of the first half of the events brought up to date with that of the rest."""
    dp = event_points(spark, sf_dir)
    return chunks.update_index(chunks.chunk_index(dp.where("seq % 2 = 0"), "epoch"), chunks.chunk_index(dp.where("seq % 2 = 1"), "epoch"), "epoch")


_RANGE = f"WITH {DP} SELECT series_id, ts_nanos, value FROM dp WHERE ts_nanos >= {FROM} AND ts_nanos < {TO}"


@query(_RANGE)
def range_read(spark, sf_dir):
    return read.range_read(event_points(spark, sf_dir), FROM, TO).select("series_id", "ts_nanos", "value")


@query(_RANGE)
def store_range_read(spark, sf_dir):
    """Through the stored layout: time blocks are pruned, the range is pushed to the files."""
    path = scratch(spark, "store")
    write_points(event_points(spark, sf_dir).select("series_id", "ts_nanos", "value"), path, DAY)
    return read_points(spark, path, FROM, TO, DAY).select("series_id", "ts_nanos", "value")


@query(f"WITH {DP}, i AS ({_INDEX}) SELECT * FROM i WHERE last_ns >= {FROM} AND first_ns < {TO}")
def chunk_prune(spark, sf_dir):
    return chunks.prune(chunks.chunk_index(event_points(spark, sf_dir), "epoch"), FROM, TO)


_BLOCK = 2 * 3600 * NS


@query(f"WITH {DP} SELECT series_id, ts_nanos // {_BLOCK} AS block, count(*) AS n_points FROM dp GROUP BY 1, 2")
def time_blocks(spark, sf_dir):
    dp = event_points(spark, sf_dir).withColumn("block", chunks.block_of("ts_nanos", _BLOCK))
    return dp.groupBy("series_id", "block").agg(F.count(F.lit(1)).alias("n_points"))


_COMPACT = f"""WITH RECURSIVE {DP}, i AS (SELECT series_id, epoch, 16 * count(*) AS size, row_number() OVER (PARTITION BY series_id ORDER BY epoch) AS k FROM dp GROUP BY 1, 2),
f AS (SELECT series_id, epoch, k, size AS total, 0 AS chunk_no FROM i WHERE k = 1
  UNION ALL SELECT i.series_id, i.epoch, i.k, CASE WHEN f.total + i.size <= {TARGET} THEN f.total + i.size ELSE i.size END,
    CASE WHEN f.total + i.size <= {TARGET} THEN f.chunk_no ELSE f.chunk_no + 1 END FROM f JOIN i ON i.series_id = f.series_id AND i.k = f.k + 1)
SELECT series_id, epoch, CAST(chunk_no AS BIGINT) AS chunk_no FROM f"""


@query(_COMPACT)
def compact_greedy(spark, sf_dir):
    runs = chunks.chunk_index(event_points(spark, sf_dir), "epoch")
    return chunks.compact(runs, "epoch", target=TARGET).select("series_id", "epoch", "chunk_no")


@query(_COMPACT)
def compact_greedy_continued(spark, sf_dir):
    """The same in two flushes: the later days go on from the last chunk that the earlier ones left."""
    runs = chunks.chunk_index(event_points(spark, sf_dir), "epoch")
    one = chunks.compact(runs.where("epoch < date'2024-01-15'"), "epoch", target=TARGET)
    two = chunks.compact(runs.where("epoch >= date'2024-01-15'"), "epoch", target=TARGET, last=chunks.last_chunks(one))
    return one.unionByName(two).select("series_id", "epoch", "chunk_no")


@query(f"WITH {DP} SELECT series_id, ts_nanos, value, (row_number() OVER (PARTITION BY series_id ORDER BY ts_nanos) - 1) // 32 AS part FROM dp")
def split_large(spark, sf_dir):
    return chunks.split_large(event_points(spark, sf_dir), 32).select("series_id", "ts_nanos", "value", "part")


_LOG = f"""WITH {DP}, l AS (SELECT *, length(series_id) + 16 AS len FROM dp),
log AS (SELECT series_id, ts_nanos, value, seq, CAST(sum(len) OVER (ORDER BY seq) - len AS BIGINT) // 98304 AS chunk_idx FROM l)"""


def _log(spark, sf_dir) -> DataFrame:
    return commitlog.log_chunks(event_points(spark, sf_dir), "seq", F.length("series_id") + 16).select("series_id", "ts_nanos", "value", "seq", "chunk_idx")


@query(_LOG + " SELECT chunk_idx, count(*) AS n_records FROM log GROUP BY 1")
def log_chunks(spark, sf_dir):
    return _log(spark, sf_dir).groupBy("chunk_idx").agg(F.count(F.lit(1)).alias("n_records"))


@query(_LOG + " SELECT CAST(coalesce(max(chunk_idx), -1) AS BIGINT) AS latest FROM log")
def log_latest(spark, sf_dir):
    return commitlog.latest_index(_log(spark, sf_dir))


@query(_LOG + " SELECT CAST(max(chunk_idx) + 1 AS BIGINT) AS token FROM log")
def log_token(spark, sf_dir):
    return commitlog.rotation_token(_log(spark, sf_dir))


@query(_LOG + " SELECT series_id, ts_nanos, value, seq, chunk_idx FROM log WHERE chunk_idx >= 1")
def log_truncate(spark, sf_dir):
    return commitlog.truncate(_log(spark, sf_dir), 1)


@query(_LOG + " SELECT DISTINCT series_id, ts_nanos, value FROM log")
def log_replay(spark, sf_dir):
    """Chunk 0 is flushed to the store; the store and the whole log give every point once."""
    log = _log(spark, sf_dir)
    return commitlog.replay(log.where("chunk_idx = 0"), log)


@query(f"""WITH {DP}, l AS (SELECT *, length(series_id) + 16 AS len FROM dp), o AS (SELECT *, sum(len) OVER (ORDER BY seq) - len AS pending FROM l)
SELECT pending <= 100000 AS accepted, count(*) AS n_records FROM o GROUP BY 1""")
def log_backpressure(spark, sf_dir):
    rows = commitlog.queue_admits(event_points(spark, sf_dir), "seq", F.length("series_id") + 16, most=100_000)
    return rows.groupBy("accepted").agg(F.count(F.lit(1)).alias("n_records"))


@query(f"WITH {DP} SELECT series_id, ts_nanos, value FROM dp")
def log_records(spark, sf_dir):
    """Log records are decodable on their own."""
    return commitlog.record(event_points(spark, sf_dir)).select(commitlog.parse_record(F.col("payload")).alias("r")).select("r.*")


@query(f"WITH {TAGS} SELECT series_id FROM tags WHERE seg = 'BUILDING'")
def tag_exact(spark, sf_dir):
    return tags.exact(customer_tags(spark, sf_dir), "mktsegment", "BUILDING")


@query(f"WITH {TAGS}, {ORD} SELECT o.series_id, o.ts_nanos, o.value FROM ord o JOIN tags t ON o.series_id = t.series_id WHERE seg = 'BUILDING' AND nat = 3")
def tag_and(spark, sf_dir):
    """Points of the series that have both terms."""
    wanted = tags.all_of(customer_tags(spark, sf_dir), [("mktsegment", "BUILDING"), ("nation", "3")])
    return read.read_batch(order_points(spark, sf_dir), wanted).select("series_id", "ts_nanos", "value")


@query(f"WITH {TAGS} SELECT series_id FROM tags WHERE seg = 'BUILDING' OR nat = 3")
def tag_or(spark, sf_dir):
    return tags.any_of(customer_tags(spark, sf_dir), [("mktsegment", "BUILDING"), ("nation", "3")])


@query(f"WITH {TAGS} SELECT series_id FROM tags WHERE seg <> 'BUILDING'")
def tag_not(spark, sf_dir):
    return tags.none_of(customer_tags(spark, sf_dir), [("mktsegment", "BUILDING")])


@query(f"WITH {TAGS} SELECT series_id FROM tags WHERE regexp_matches(seg, '^(BUILD|MACH)')")
def tag_regex(spark, sf_dir):
    return tags.regex(customer_tags(spark, sf_dir), "mktsegment", "^(BUILD|MACH)")


@query(f"WITH {TAGS} SELECT 'mktsegment' AS tag_key, seg AS tag_value, count(*) AS n_series FROM tags GROUP BY 2 UNION ALL SELECT 'nation', CAST(nat AS VARCHAR), count(*) FROM tags GROUP BY 2")
def tag_postings(spark, sf_dir):
    """Set bits of each term's bitmap over integer series ids."""
    t = customer_tags(spark, sf_dir)
    return tags.posting_counts(tags.postings(t, tags.dictionary(t)))


@query(f"WITH {DP} SELECT series_id, ts_nanos, value FROM dp WHERE ts_nanos >= (SELECT max(ts_nanos) FROM dp) - {WEEK}")
def ttl_points(spark, sf_dir):
    return chunks.expire(event_points(spark, sf_dir), WEEK).select("series_id", "ts_nanos", "value")


@query(f"WITH {DP}, i AS ({_INDEX}) SELECT * FROM i WHERE last_ns >= (SELECT max(last_ns) FROM i) - {WEEK}")
def ttl_chunks(spark, sf_dir):
    return chunks.expire(chunks.chunk_index(event_points(spark, sf_dir), "epoch"), WEEK, last="last_ns")


_IDENTITY = f"WITH {DP} SELECT series_id, ts_nanos, value FROM dp"


@query(_IDENTITY)
def codec_roundtrip(spark, sf_dir):
    return codec.decode(codec.encode(event_points(spark, sf_dir))).select("series_id", "ts_nanos", "value")


@query(f"WITH {DP} SELECT series_id, ts_nanos, value, CAST(row_number() OVER (PARTITION BY series_id ORDER BY arrival) AS BIGINT) AS place FROM dp")
def state_resume(spark, sf_dir):
    """The second half of each series' arrivals is encoded from the first half's saved state."""
    dp = event_points(spark, sf_dir)
    return codec.decode(codec.encode_resumed(dp.where("arrival < 500000"), dp.where("arrival >= 500000 or arrival is null"))).select("series_id", "ts_nanos", "value", "place")


@query(f"WITH {DP} SELECT series_id, ts_nanos, value, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts_nanos) AS BIGINT) AS place FROM dp")
def merge_streams(spark, sf_dir):
    """Each event type's stream is encoded alone; the streams of a user are merged into one."""
    each = codec.encode(event_points(spark, sf_dir), "ts_nanos", chunk="stream")
    return codec.decode(merge.merge_streams(each)).select("series_id", "ts_nanos", "value", "place")


@query(_IDENTITY)
def wire_roundtrip(spark, sf_dir):
    return wire.parse_writes(wire.write_requests(event_points(spark, sf_dir), order="seq")).select("series_id", "ts_nanos", "value")


def _event_stream(spark, sf_dir) -> DataFrame:
    """The events as a stream of points."""
    folder = sf_dir.rstrip("/")
    path_ = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/events.parquet")
    whole = path_.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path_).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(f"{folder}/events.parquet").schema)
    events = reader.parquet(f"{folder}/events.parquet") if whole else reader.option("pathGlobFilter", "events.parquet").parquet(folder)
    return events.select(F.col("user_id").cast("string").alias("series_id"), nanos(F.col("ts")).alias("ts_nanos"), "value", F.col("event_id").alias("arrival"))


@query(_IDENTITY)
def stream_ingest(spark, sf_dir):
    """The events through the micro-batch persist loop into the raw engine's store."""
    engine = Engine(spark, scratch(spark, "stream"), "raw")
    streaming.persist_loop(_event_stream(spark, sf_dir), engine, scratch(spark, "checkpoint"), every=None).awaitTermination()
    return engine.points().select("series_id", "ts_nanos", "value")


@query(_admit_sql("dp", "series_id", "seq", _OK))
def admit_stream(spark, sf_dir):
    """Stateful admission of the event stream in event order."""
    path = scratch(spark, "admitted")
    admitted = streaming.admit_stream(_event_stream(spark, sf_dir)).writeStream.format("parquet").option("checkpointLocation", scratch(spark, "checkpoint"))
    admitted.outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.parquet(path).where("status = 'OK'").select("series_id", "ts_nanos", "value")


@query(f"WITH {HR} SELECT DISTINCT series_id, ts_nanos FROM hr")
def late_filter(spark, sf_dir):
    """Each time of a series once, of a stream in which none is later than the watermark allows."""
    path, hour = scratch(spark, "late"), F.lit(3600 * NS).cast("bigint")
    stream = _event_stream(spark, sf_dir).join(spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").select(F.col("event_id").alias("arrival"), "event_type"), "arrival")
    hourly = stream.select(F.col("event_type").alias("series_id"), (F.floor(F.col("ts_nanos") / hour).cast("bigint") * hour).alias("ts_nanos"))
    once = streaming.late_filter(hourly, "400 days").writeStream.format("parquet").option("checkpointLocation", scratch(spark, "checkpoint"))
    once.outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.parquet(path).select("series_id", "ts_nanos")


@query(f"""WITH {DP}, a AS (SELECT *, max(ts_nanos) OVER (PARTITION BY series_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT series_id, ts_nanos, value, arrival AS seq FROM dp)),
f AS (SELECT min(seq) AS first FROM a WHERE ts_nanos <= before)
SELECT series_id, ts_nanos, value, CASE WHEN seq > first THEN 'ABORTED' WHEN before IS NULL OR ts_nanos > before THEN 'OK' WHEN ts_nanos = before THEN 'DUPLICATE' ELSE 'OUT_OF_ORDER' END AS status FROM a, f""")
def admit_abort_batch(spark, sf_dir):
    return ingest.admit(event_points(spark, sf_dir), abort_batch=True).select("series_id", "ts_nanos", "value", "status")


@query(f"WITH {HR} SELECT series_id, ts_nanos, arg_max(value, seq) AS value FROM hr GROUP BY 1, 2")
def engine_raw(spark, sf_dir):
    """The raw engine: two batches, a flush between them, points of both visible, the last write of a time."""
    hr = hourly_points(spark, sf_dir).withColumnRenamed("seq", "arrival")
    engine = Engine(spark, scratch(spark, "raw"), "raw")
    middle = hr.agg(F.expr("cast(percentile_approx(arrival, 0.5) as bigint)").alias("m")).first()["m"] or 0
    engine.write_batch(hr.where(F.col("arrival") <= middle))
    engine.flush()
    engine.write_batch(hr.where(F.col("arrival") > middle))
    return engine.points().select("series_id", "ts_nanos", "value")


_HALVES = _admit_sql("dp", "series_id, epoch < DATE '2024-01-15'", "arrival", _OK)


def _halves(spark, sf_dir, root: str) -> Engine:
    """A raw-block engine with the first half of the days flushed and the second one logged."""
    dp = event_points(spark, sf_dir)
    engine = Engine(spark, root, "raw-block")
    engine.write_batch(dp.where("epoch < date'2024-01-15'"))
    engine.flush()
    engine.write_batch(dp.where("epoch >= date'2024-01-15'"))
    return engine


@query(_HALVES)
def engine_raw_block(spark, sf_dir):
    """The raw-block engine: the flush starts fresh encoders, so each half of the days is admitted alone and both are read."""
    return _halves(spark, sf_dir, scratch(spark, "raw-block")).points().select("series_id", "ts_nanos", "value")


@query(_HALVES)
def engine_replay(spark, sf_dir):
    """An engine opened anew on the folder finds the logged half beside the stored one, and flushes it."""
    root = scratch(spark, "replay")
    _halves(spark, sf_dir, root)
    again = Engine(spark, root, "raw-block")
    again.flush()
    return again.points().select("series_id", "ts_nanos", "value")


@query(f"WITH {HR}, s AS (SELECT *, seq % 2 AS half FROM hr) SELECT series_id, ts_nanos, arg_max(value, half * 10000000000 + seq) AS value FROM s GROUP BY 1, 2")
def engine_restart(spark, sf_dir):
    """Even events, a flush, then odd ones through an engine opened anew: later writes win though their own numbers start again."""
    hr, root = hourly_points(spark, sf_dir).withColumnRenamed("seq", "arrival"), scratch(spark, "restart")
    first = Engine(spark, root, "raw")
    first.write_batch(hr.where("arrival % 2 = 0"))
    first.close()
    second = Engine(spark, root, "raw")
    second.write_batch(hr.where("arrival % 2 = 1"))
    return second.points().select("series_id", "ts_nanos", "value")


@query(f"""WITH {DP}, s AS (SELECT *, CASE WHEN epoch < DATE '2024-01-10' THEN 0 WHEN epoch < DATE '2024-01-20' THEN 1 ELSE 2 END AS third FROM dp)
SELECT series_id, ts_nanos, value, CAST(row_number() OVER (PARTITION BY series_id ORDER BY third, arrival) AS BIGINT) AS place FROM s""")
def engine_direct_compress(spark, sf_dir):
    """Two flushes of compressed streams, the second one from the states that the first one saved, and a third batch that is only
    logged: every point in its order of arrival."""
    dp = event_points(spark, sf_dir)
    engine = Engine(spark, scratch(spark, "direct"), "direct-compress")
    engine.write_batch(dp.where("epoch < date'2024-01-10'"))
    engine.flush()
    engine.write_batch(dp.where("epoch >= date'2024-01-10' and epoch < date'2024-01-20'"))
    engine.flush()
    engine.write_batch(dp.where("epoch >= date'2024-01-20'"))
    return ingest.append(engine.points()).select("series_id", "ts_nanos", "value", "place")


@query(_HALVES.replace(_OK, f"{_OK} AND series_id = '8'").replace("ts_nanos > before", "ts_nanos > before)").replace("WHERE before", "WHERE (before"))
def engine_read(spark, sf_dir):
    """One series out of the store, by the chunk index, and the log."""
    return _halves(spark, sf_dir, scratch(spark, "read")).read("8").select("series_id", "ts_nanos", "value")


@query(f"WITH {HR}, u AS (SELECT series_id, ts_nanos, arg_max(value, seq) AS value FROM hr GROUP BY 1, 2) SELECT * FROM u WHERE series_id = 'click' AND ts_nanos >= {FROM} AND ts_nanos < {TO}")
def engine_read_range(spark, sf_dir):
    engine = Engine(spark, scratch(spark, "range"), "raw")
    engine.write_batch(hourly_points(spark, sf_dir).withColumnRenamed("seq", "arrival"))
    engine.flush()
    return engine.read_range("click", FROM, TO).select("series_id", "ts_nanos", "value")


@query(f"""WITH {DP}, ids AS (SELECT unnest(['8', '46', '101', 'no-such']) AS series_id)
SELECT i.series_id, CAST(count(d.ts_nanos) AS BIGINT) AS n_points, min(d.ts_nanos) AS first_ns, max(d.ts_nanos) AS last_ns FROM ids i LEFT JOIN dp d ON i.series_id = d.series_id GROUP BY 1""")
def gateway_read(spark, sf_dir):
    """Points written into an engine, and a read request answered as the gateway does."""
    ids = ["8", "46", "101", "no-such"]
    engine = Engine(spark, scratch(spark, "gateway"), "raw")
    engine.write_batch(event_points(spark, sf_dir))
    status, body = wire.serve(spark, engine, wire.PATHS["read"], json.dumps({"batch": [{"series_id": i} for i in ids]}))
    rows = spark.createDataFrame([("".join(body),)], "value string").where(F.lit(status == 200))
    entry_ = F.explode(F.from_json("value", "struct<batch:array<struct<series_id:string,datapoints:array<struct<timestamp_nanos:bigint,value:double>>>>>")["batch"])
    times = F.transform("e.datapoints", lambda d: d["timestamp_nanos"])
    return rows.select(entry_.alias("e")).select("e.series_id", F.size(times).cast("bigint").alias("n_points"), F.array_min(times).alias("first_ns"), F.array_max(times).alias("last_ns"))


@query("SELECT CAST(50 AS BIGINT) AS workers, CAST(100000 AS BIGINT) AS points, CAST(1999 AS BIGINT) AS last_ns, CAST(1999 AS DOUBLE) AS last_value")
def load_generator(spark, sf_dir):
    p = generator.points(spark, 100_000)
    worker = F.element_at(F.split("series_id", "-"), 2).cast("bigint") % 50
    return p.agg(F.count_distinct(worker).alias("workers"), F.count(F.lit(1)).alias("points"), F.max("ts_nanos").alias("last_ns"), F.max("value").alias("last_value"))


@query(f"WITH {DP}, i AS (SELECT series_id, ts_nanos // {_BLOCK} AS block, min(ts_nanos) AS first_ns, max(ts_nanos) AS last_ns, count(*) AS n_points, CAST(16 * count(*) AS BIGINT) AS size_bytes FROM dp GROUP BY 1, 2) SELECT * FROM i")
def store_index(spark, sf_dir):
    """The index that a published version carries."""
    store = Store(spark, scratch(spark, "versions"), _BLOCK)
    store.publish(event_points(spark, sf_dir).select("series_id", "ts_nanos", "value"))
    return store.index()
