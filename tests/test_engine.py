import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import codec
from strandline.operators import chunks, commitlog, ingest, merge, read, tags
from strandline.plans import catalogue
from strandline.plans.engine import Engine
from strandline.sources import generator, model, wire
from strandline.sources.log import CommitLog, LogError, QueueFull
from strandline.sources.store import Store
from strandline.streaming import ingest as streaming

S = 1_000_000_000


def points(spark, rows):
    return spark.createDataFrame(rows, model.WRITE)


def times(df):
    return [r.ts_nanos for r in df.collect()]


@pytest.mark.parametrize("streams, want", [
    ([[0], [1]], [0, 1]), ([[1], [0]], [0, 1]), ([[10, 11], [7], [8, 9], [1, 3]], [1, 3, 7, 8, 9, 10, 11]), ([[], [2]], [2]), ([[4], [4]], [4, 4]),
])
def test_merge_of_streams(spark, streams, want):
    rows = [("s", t * S, float(t), k) for k, s in enumerate(streams) for t in s]
    df = points(spark, rows).withColumnRenamed("arrival", "stream")
    got = merge.kway_merge(df).orderBy("place").collect()
    assert [r.ts_nanos // S for r in got] == want
    from strandline.functions import codec

    encoded = codec.encode(df, "ts_nanos", chunk="stream")
    assert sorted(r.ts_nanos // S for r in codec.decode(merge.merge_streams(encoded)).collect()) == want


@pytest.mark.parametrize("kind", ["raw", "direct-compress", "raw-block"])
def test_write_read_before_and_after_flush(spark, tmp_path, kind):
    e = Engine(spark, f"file://{tmp_path}/{kind}", kind)
    e.write("test-id", 0, 0.0)
    e.write("test-id", S, 1.0)
    assert times(e.read("test-id")) == [0, S]
    assert e.flush() == 0 and e.flush() == 0  # an idle flush publishes nothing
    assert times(e.read("test-id")) == [0, S]
    assert e.read("no-such").count() == 0
    e.write("test-id", 0, 9.0)
    got = [(r.ts_nanos, r.value) for r in e.read("test-id").collect()]
    if kind == "raw":
        assert got == [(0, 9.0), (S, 1.0)]
    elif kind == "direct-compress":
        assert got == [(0, 0.0), (S, 1.0), (0, 9.0)]  # arrival order
    else:
        assert got == [(0, 0.0), (0, 9.0), (S, 1.0)]  # a flush starts a fresh encoder: both copies
    e.flush()
    assert e.read("test-id").count() == len(got)
    assert [(r.series_id, len(r.datapoints)) for r in e.read_batch(["test-id", "x"]).orderBy("series_id").collect()] == [("test-id", len(got)), ("x", 0)]
    again = Engine(spark, f"file://{tmp_path}/{kind}", kind)  # opened anew: the same points, in the same order
    assert [(r.ts_nanos, r.value) for r in again.read("test-id").collect()] == got
    assert times(again.read_range("test-id", 0, S)) == [t for t, _ in got if t < S]


@pytest.mark.parametrize("kind", ["raw", "direct-compress", "raw-block"])
def test_a_restart_loses_no_write(spark, tmp_path, kind):
    root = f"file://{tmp_path}/{kind}"
    e = Engine(spark, root, kind)
    e.write("a", 1, 1.0)
    e.write("a", 1, 2.0)
    e.flush()
    e = Engine(spark, root, kind)
    e.write("a", 1, 99.0)  # not flushed
    e = Engine(spark, root, kind)
    want = {"raw": [99.0], "direct-compress": [1.0, 2.0, 99.0], "raw-block": [1.0, 99.0]}[kind]
    assert [r.value for r in e.read("a").collect()] == want
    if kind == "raw-block":  # admission too goes on where it was
        assert e.write("a", 1, 5.0).first().status == "DUPLICATE" and e.write("a", 0, 5.0).first().status == "OUT_OF_ORDER"
    e.flush()
    e.flush()
    assert [r.value for r in Engine(spark, root, kind).read("a").collect()] == want


def test_half_written_batches_do_not_count(spark, tmp_path):
    root = f"file://{tmp_path}/h"
    e = Engine(spark, root, "raw")
    e.write("a", 1, 1.0)
    e.buffer().withColumn("status", F.lit("OK")).write.parquet(f"{root}/log/batches/lost")  # no commit names it
    assert times(Engine(spark, root, "raw").read("a")) == [1]


def test_many_unflushed_writes_keep_the_plan_small(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/m", "raw-block")
    lines = []
    for t in range(10):
        e.write("a", t, float(t))
        lines.append(len(e.points()._jdf.queryExecution().analyzed().toString().splitlines()))
    assert lines[-1] <= lines[1] + 2 and times(e.read("a")) == list(range(10))
    assert e.write("a", 9, 0.0).first().status == "DUPLICATE"


def test_empty_and_rejected_batches(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e", "raw-block")
    assert e.write_batch(points(spark, [])).count() == 0 and e.flush() == -1
    got = e.write_batch(points(spark, [(None, 1, 1.0, 0), ("a", None, 1.0, 1), ("a", 1, None, 2)])).collect()
    assert [r.status for r in got] == ["INVALID"] * 3
    assert e.flush() == -1 and e.points().count() == 0
    e.write("a", 1, 1.0)
    assert e.flush() == 0 and times(e.read("a")) == [1]
    e.close()
    with pytest.raises(LogError):
        e.write("a", 2, 1.0)
    with pytest.raises(LogError):
        e.close()


def test_a_full_log_is_flushed_first(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/q", "raw", queue_bytes=40)
    for t in range(4):
        e.write("a", t, 0.0)
    assert e.store.version() >= 0 and times(e.read("a")) == [0, 1, 2, 3]


def test_parts_are_merged_and_chunks_go_on(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/p", "raw-block", block_ns=1000, target=64)
    for k in range(6):
        e.write_batch(points(spark, [("a", 10 * k + j, float(k), j) for j in range(2)] + [("b", 5000 + k, 0.0, 9)]))
        e.flush()
    assert len(e.store.manifest()["parts"]) < 6
    assert times(e.read("a")) == [10 * k + j for k in range(6) for j in range(2)] and e.read("b").count() == 6
    runs = e.store.runs().where("series_id = 'a'").collect()
    assert sum(r.n_points for r in runs) == 12 and max(r.chunk_no for r in runs) >= 1  # 64 bytes hold two runs of two points
    assert [(r.n_points, r.first_ns, r.last_ns) for r in e.store.index().where("series_id = 'a'").collect()] == [(12, 0, 51)]
    raw = Engine(spark, f"file://{tmp_path}/r", "raw")
    for k in range(4):
        raw.write("a", 1, float(k))
        raw.flush()
    assert [r.value for r in raw.read("a").collect()] == [3.0] and raw.store.points().count() < 4


def test_reads_open_only_the_blocks_of_the_index(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/i", "raw-block", block_ns=100)
    e.write_batch(points(spark, [("a", 5, 0.0, 0), ("a", 905, 0.0, 1), *[("b", t, 0.0, t) for t in range(10, 1000, 50)]]))
    e.flush()
    files = lambda df: {f.split("block=")[1].split("/")[0] for f in df.inputFiles()}
    assert files(e.store.points(ids=["a"])) == {"0", "9"} and files(e.store.points(0, 100, ["a"])) == {"0"}
    assert e.store.points(ids=["none"]).count() == 0


def test_log_states(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/l", model.WRITE, queue_bytes=100)
    with pytest.raises(LogError):
        log.append(points(spark, [("a", 1, 1.0, 0)]))
    with pytest.raises(LogError):
        log.close()
    assert log.open() == -1
    with pytest.raises(LogError):
        log.open()
    with pytest.raises(LogError, match="empty"):
        log.append(points(spark, []))
    assert log.append(points(spark, [("some-data", 1, 1.0, 0)])) == 0 and log.rotation_token() == 1
    token = log.rotation_token()
    assert log.append(points(spark, [("some-data", 2, 1.0, k) for k in range(9)])) == 1
    with pytest.raises(QueueFull):
        log.append(points(spark, [("a", 3, 1.0, 0)]))
    log.truncate(None)
    assert log.rows().count() == 10
    log.truncate(token)
    assert log.rows().count() == 9
    again = CommitLog(spark, f"file://{tmp_path}/l", model.WRITE)
    assert again.open() == 1
    again.truncate(2)
    done = []
    again.close(lambda: done.append(1))
    assert done == [1]
    with pytest.raises(LogError):
        again.append(points(spark, [("a", 1, 1.0, 0)]))
    assert CommitLog(spark, f"file://{tmp_path}/l", model.WRITE).open() == -1


def test_unknown_engine(spark):
    with pytest.raises(ValueError):
        Engine(spark, "file:///tmp/none", "other")


def test_raw_block_rejects_in_the_epoch(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/x", "raw-block")
    got = e.write_batch(points(spark, [("a", 1, 1.0, 0), ("a", 0, 0.0, 1), ("a", 1, 2.0, 2), ("b", 0, 0.0, 3), ("a", 2, 2.0, 4), (None, 1, 1.0, 5)])).orderBy("arrival").collect()
    assert [r.status for r in got] == ["OK", "OUT_OF_ORDER", "DUPLICATE", "OK", "OK", "INVALID"]
    assert e.write("a", 2, 5.0).first().status == "DUPLICATE"
    assert times(e.read("a")) == [1, 2]


def test_admission_equals_a_sequential_simulation(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.randrange(60), 0.0, i, rng.randrange(2)) for i in range(400)]
    df = spark.createDataFrame(rows, "series_id string, ts_nanos bigint, value double, arrival bigint, epoch int")
    last, want = {}, {}
    for s, t, _, i, e in rows:
        p = last.get((s, e))
        want[i] = "OK" if p is None or t > p else "DUPLICATE" if t == p else "OUT_OF_ORDER"
        if want[i] == "OK":
            last[s, e] = t
    for block in (None, 7, 1000):
        assert {r.arrival: r.status for r in ingest.admit(df, epoch="epoch", block=block).collect()} == want
    first = {e: min(i for s, t, _, i, x in rows if x == e and want[i] != "OK") for e in (0, 1)}
    got = {r.arrival: (r.status, r.epoch) for r in ingest.admit(df, epoch="epoch", abort_batch=True).collect()}
    assert all((s == "ABORTED") == (i > first[e]) for i, (s, e) in got.items())
    assert ingest.admit(df.limit(0)).count() == 0


def test_upsert_ties_and_stored(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 5), ("a", 1, 2.0, 7), ("a", 1, 3.0, 6)], "series_id string, ts_nanos bigint, value double, seq bigint")
    assert [r.value for r in ingest.upsert(df).collect()] == [2.0]
    stored = spark.createDataFrame([("a", 1, 9.0), ("a", 2, 8.0)], model.POINT)
    assert sorted((r.ts_nanos, r.value) for r in ingest.upsert(df, stored=stored).collect()) == [(1, 2.0), (2, 8.0)]


def test_runs_are_sorted(spark):
    df = points(spark, [("a", t, 0.0, i) for i, t in enumerate([3, 4, 4, 1, 2, 9, 5])])
    runs = {}
    for r in merge.run_split(df).orderBy("arrival").collect():
        runs.setdefault(r.run, []).append(r.ts_nanos)
    assert list(runs.values()) == [[3, 4], [4], [1, 2, 9], [5]]


#: Points of equal arrival; in order of arrival, then time, then value.
TIED = [("a", 5, 0.5, 9), ("a", 5, 1.0, 9), ("a", 9, 0.0, 9), ("a", 6, 2.0, 10), ("a", 7, 2.0, 19), ("a", 8, 2.0, 19), ("a", 8, 3.0, 20)]


def test_tied_arrivals_in_blocked_runs(spark):
    for rows in (TIED, TIED[::-1]):
        got = merge.run_split(points(spark, rows).coalesce(1), block=10).collect()
        assert sorted((r.arrival, r.ts_nanos, r.value, r.run) for r in got) == [(a, t, v, run) for (_, t, v, a), run in zip(TIED, [0, 1, 1, 2, 2, 2, 3], strict=True)]


def test_tied_arrivals_in_runs(spark):
    for rows in (TIED, TIED[::-1]):
        got = merge.run_split(points(spark, rows).coalesce(1)).collect()
        assert sorted((r.arrival, r.ts_nanos, r.value, r.run) for r in got) == [(a, t, v, run) for (_, t, v, a), run in zip(TIED, [0, 1, 1, 2, 2, 2, 3], strict=True)]


def test_null_arrivals_are_in_the_last_run(spark):
    rows = [("a", 5, 0.5, 9), ("a", 9, 1.0, 20), ("a", 3, 2.0, 21), ("a", 7, 2.0, None), ("a", 8, 2.0, None)]
    for given in (rows, rows[::-1]):
        got = merge.run_split(points(spark, given).coalesce(1)).orderBy("ts_nanos").collect()
        assert [(r.ts_nanos, r.run) for r in got] == [(3, 1), (5, 0), (7, 1), (8, 1), (9, 0)]


def test_null_arrivals_and_series_are_in_runs_by_blocks(spark):
    rows = [("a", 5, 0.5, 9), ("a", 9, 1.0, 20), ("a", 3, 2.0, 21), ("a", 2, 2.0, None), ("a", 8, 2.0, None), (None, 4, 1.0, 8), (None, 3, 1.0, 30), (None, 3, 1.0, None)]
    for given in (rows, rows[::-1]):
        got = merge.run_split(points(spark, given).coalesce(1), block=10).collect()
        assert sorted((r.series_id or "-", r.arrival or 99, r.ts_nanos, r.run) for r in got) == [("-", 8, 4, 0), ("-", 30, 3, 1), ("-", 99, 3, 2), ("a", 9, 5, 0), ("a", 20, 9, 0), ("a", 21, 3, 1), ("a", 99, 2, 2), ("a", 99, 8, 2)]


def test_null_times_of_tied_arrivals_in_runs(spark):
    rows = [("a", 5, 0.5, 9), ("a", None, 1.0, 9), ("a", 4, 2.0, 10), ("a", 3, 2.0, 19), ("a", None, 2.0, 19), ("a", 2, 2.0, 20)]
    for block in (None, 10):
        got = merge.run_split(points(spark, rows[::-1]).coalesce(1), block=block).collect()
        assert sorted((r.arrival, r.ts_nanos or 99, r.run) for r in got) == [(9, 5, 0), (9, 99, 0), (10, 4, 0), (19, 3, 1), (19, 99, 1), (20, 2, 1)]


def test_tied_arrivals_in_blocked_places(spark):
    for rows in (TIED, TIED[::-1]):
        got = ingest.append(points(spark, rows).coalesce(1), block=10).orderBy("place").collect()
        assert [(r.series_id, r.ts_nanos, r.value, r.arrival, r.place) for r in got] == [(*p, k + 1) for k, p in enumerate(TIED)]


def test_tied_arrivals_in_places(spark):
    for rows in (TIED, TIED[::-1]):
        got = ingest.append(points(spark, rows).coalesce(1)).orderBy("place").collect()
        assert [(r.series_id, r.ts_nanos, r.value, r.arrival, r.place) for r in got] == [(*p, k + 1) for k, p in enumerate(TIED)]


def test_null_arrivals_have_the_last_places(spark):
    rows = [("a", 5, 0.5, 9), ("a", 7, 1.0, 20), ("a", 6, 2.0, None), ("a", None, 2.0, None), ("b", 1, 0.0, None)]
    for given in (rows, rows[::-1]):
        got = ingest.append(points(spark, given).coalesce(1)).orderBy("series_id", "place").collect()
        assert [(r.series_id, r.ts_nanos, r.value, r.arrival, r.place) for r in got] == [(*p, k) for p, k in zip(rows, [1, 2, 3, 4, 1], strict=True)]


def test_null_arrivals_and_series_have_places_in_blocks(spark):
    rows = [("a", 5, 0.5, 9), ("a", 7, 1.0, 20), ("a", 6, 2.0, None), ("a", None, 2.0, None), ("b", 1, 0.0, None), (None, 3, 1.0, 8), (None, 2, 1.0, 30), (None, 2, 1.0, None)]
    for given in (rows, rows[::-1]):
        got = ingest.append(points(spark, given).coalesce(1), block=10).orderBy(F.asc_nulls_last("series_id"), "place").collect()
        assert [(r.series_id, r.ts_nanos, r.value, r.arrival, r.place) for r in got] == [(*p, k) for p, k in zip(rows, [1, 2, 3, 4, 1, 1, 2, 3], strict=True)]
    untimed = points(spark, [("a", None, 1.0, 0), ("a", 25, 2.0, 1), ("a", 3, 3.0, 2)]).withColumn("stream", F.lit("s"))
    assert [(r.ts_nanos, r.place) for r in merge.kway_merge(untimed, block=10).orderBy("place").collect()] == [(3, 1), (25, 2), (None, 3)]


def test_encoded_points_keep_nulls(spark):
    first = [("a", 5, 0.5, 1), ("a", None, 1.0, 2), ("a", 7, None, 3), (None, 1, 1.0, 4)]
    second = [("a", 9, 0.0, 10), ("a", None, None, None), ("b", 2, 0.0, 11), ("b", 1, 0.0, None), (None, 2, 1.0, 12)]
    for a, b in ((first, second), (first[::-1], second[::-1])):
        got = codec.decode(codec.encode_resumed(points(spark, a).coalesce(1), points(spark, b).coalesce(1), most_points=2)).collect()
        want = [("-", 1, 1, 1.0), ("-", 2, 2, 1.0), ("a", 1, 5, 0.5), ("a", 2, None, 1.0), ("a", 3, 7, None), ("a", 4, 9, 0.0), ("a", 5, None, None), ("b", 1, 2, 0.0), ("b", 2, 1, 0.0)]
        assert sorted(((r.series_id or "-", r.place, r.ts_nanos, r.value) for r in got), key=lambda r: r[:2]) == want


def test_state_resume_has_points_without_an_arrival(spark, tmp_path):
    events = spark.createDataFrame([(1, 3, 1.0), (None, 2, 2.0), (100, 1, 3.0), (None, 4, None)], "event_id bigint, s int, value double")
    events.selectExpr("event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, s) ts", "7L user_id", "'view' event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.state_resume(spark, str(tmp_path)).orderBy("place").collect()
    assert [(r.place, r.value) for r in got] == [(1, 1.0), (2, 3.0), (3, 2.0), (4, None)]


def test_tied_arrivals_keep_their_order_through_a_flush(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/tied", "direct-compress")
    for k, rows in enumerate((TIED, TIED[::-1], TIED[::-1])):
        e.write_batch(points(spark, rows).coalesce(1))
        for flushed in (False, True):
            want = [(t, v) for _, t, v, _ in TIED] * (k + 1)
            assert [(r.ts_nanos, r.value) for r in e.read("a").collect()] == want
            assert [(r.ts_nanos, r.value) for r in ingest.append(e.points()).orderBy("place").collect()] == want
            if not flushed:
                e.flush()


def test_null_arrivals_are_last_of_their_batch(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/absent", "direct-compress")
    for flushed in (False, True):
        e.write_batch(points(spark, [("a", 1, 0.0, None), ("a", 3, 1.0, 0), ("a", 2, 2.0, 5)]).coalesce(1))
        assert times(e.read("a"))[-3:] == [3, 2, 1]
        if not flushed:
            e.flush()
            assert times(e.read("a")) == [3, 2, 1]


def test_compaction_splits_again_and_skips_empty_runs(spark):
    sizes = [30, 60, 20, 0, 90, 5, 200, 1]
    df = spark.createDataFrame([("a", k, n) for k, n in enumerate(sizes)], "series_id string, run bigint, size_bytes bigint")
    want, chunk, room = {}, -1, 0
    for k, n in enumerate(sizes):
        if n:
            chunk, room = (chunk, room + n) if chunk >= 0 and room + n <= 100 else (chunk + 1, n)
            want[k] = chunk
    assert {r.run: r.chunk_no for r in chunks.compact(df, "run", target=100).collect()} == want
    for cut in (1, 3, 6):  # in two flushes
        one = chunks.compact(df.where(F.col("run") < cut), "run", target=100)
        two = chunks.compact(df.where(F.col("run") >= cut), "run", target=100, last=chunks.last_chunks(one))
        assert {r.run: r.chunk_no for r in one.unionByName(two).collect()} == want
    assert max(want.values()) >= 2  # chunks after the first split have numbers of their own


def test_blocks_of_negative_times(spark):
    df = spark.createDataFrame([(-1,), (0,), (9,), (10,), (2**63 - 1,)], "t bigint")
    assert [r.b for r in df.select("t", chunks.block_of("t", 10).alias("b")).orderBy("t").collect()] == [-1, 0, 0, 1, (2**63 - 1) // 10]


def test_log_lifecycle(spark):
    empty = spark.createDataFrame([], "chunk_idx bigint, seq bigint, n bigint")
    assert commitlog.latest_index(empty).first().latest == -1
    one = spark.createDataFrame([(0, 0, 9)], "chunk_idx bigint, seq bigint, n bigint")
    assert commitlog.latest_index(one).first().latest == 0
    two = one.unionByName(spark.createDataFrame([(1, 1, 9)], one.schema))
    token = commitlog.rotation_token(one).first().token
    left = commitlog.truncate(two, token)
    assert [r.chunk_idx for r in left.collect()] == [1]
    assert commitlog.latest_index(commitlog.truncate(two, 2)).first().latest == -1
    assert commitlog.truncate(two, None).count() == 2


def test_log_offsets_over_blocks_and_empty_payloads(spark):
    rng = random.Random(1)
    rows = [(i * 3, rng.choice([0, 10, 50_000, 98_304])) for i in range(200)]
    df = spark.createDataFrame(rows, "seq bigint, n bigint")
    want = dict(zip([s for s, n in rows if n], [0, *itertools.accumulate(n for _, n in rows if n)][:-1], strict=True))
    got = commitlog.running_bytes(df.where("n > 0"), "seq", F.col("n"), block=50)
    assert {r.seq: r.start_offset for r in got.collect()} == want
    assert {r.seq: r.chunk_idx for r in commitlog.log_chunks(df, "seq", F.col("n")).collect()} == {s: o // 98_304 for s, o in want.items()}


def test_wire_schema(spark):
    body = json.dumps({"batch": [{"series_id": "a", "datapoint": {"timestamp_nanos": 2**63, "value": 1}}, {"series_id": "b", "datapoint": {"timestamp_nanos": 2**63 - 1, "value": 2.5}}]})
    got = wire.parse_writes(spark.createDataFrame([(body,), ("not json",)], "value string")).collect()
    assert [(r.series_id, r.ts_nanos, r.value) for r in got] == [("a", None, 1.0), ("b", 2**63 - 1, 2.5)]


def test_gateway(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/g", "raw")
    body = {"batch": [{"series_id": "a", "datapoint": {"timestamp_nanos": 5, "value": 1.5}}]}
    serve = lambda path, body: (lambda s, pieces: (s, "".join(pieces)))(*wire.serve(spark, e, path, body))
    assert serve("/api/v1/writeBatch", json.dumps(body)) == (200, "{}")
    status, answer = serve("/api/v1/readBatch", json.dumps({"batch": [{"series_id": i} for i in ("b", "a", "z", "a")]}))
    assert status == 200
    assert json.loads(answer) == {"batch": [{"series_id": "a", "datapoints": [{"timestamp_nanos": 5, "value": 1.5}]}, {"series_id": "b", "datapoints": []}, {"series_id": "z", "datapoints": []}]}
    assert serve("/other", "")[0] == 404 and serve("/api/v1/readBatch", '{"batch":[]}') == (200, '{"batch":[]}')
    for bad in ("not json", "[]", '{"batch":[{}]}', '{"batch":[{"series_id":"a","datapoint":{"timestamp_nanos":-1,"value":1}}]}', '{"batch":[{"series_id":"a","datapoint":{"timestamp_nanos":1,"value":"x"}}]}', '{"batch":3}'):
        assert serve("/api/v1/writeBatch", bad)[0] == 400
    assert serve("/api/v1/readBatch", '{"batch":[{"series_id":5}]}')[0] == 400


def test_gateway_over_http_with_numbers_json_has_not(spark, tmp_path):
    import urllib.error
    import urllib.request

    e = Engine(spark, f"file://{tmp_path}/h", "raw")
    server = wire.listen(spark, e)
    post = lambda path, body: urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", json.dumps(body).encode(), method="POST")).read().decode()
    try:
        values = ["NaN", "Infinity", "-Infinity", 2.5, -0.0]
        batch = [{"series_id": "s", "datapoint": {"timestamp_nanos": str(k) if k % 2 else k, "value": v}} for k, v in enumerate(values)]
        assert post("/api/v1/writeBatch", {"batch": batch}) == "{}"
        got = json.loads(post("/api/v1/readBatch", {"batch": [{"series_id": "s"}]}))["batch"][0]["datapoints"]
        assert [(p["timestamp_nanos"], p["value"]) for p in got] == list(enumerate(values))
        with pytest.raises(urllib.error.HTTPError) as x:
            post("/api/v1/writeBatch", {"batch": [1]})
        assert x.value.code == 400
    finally:
        server.shutdown()


def test_store_versions_and_pruning(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", 10)
    assert s.version() == -1 and s.points().count() == 0
    first = spark.createDataFrame([("a", t, float(t)) for t in range(30)], model.POINT)
    assert s.publish(first) == 0
    assert s.publish(s.points().unionByName(spark.createDataFrame([("b", 55, 1.0)], model.POINT))) == 1
    assert s.points().count() == 31 and s.index().count() == 4
    assert sorted(r.ts_nanos for r in s.points(8, 12).collect()) == [8, 9, 10, 11]
    plan = s.points(8, 12)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "GreaterThanOrEqual(ts_nanos,8)" in plan
    s.drop_before(1)
    assert s.points().count() == 31


def test_blocked_forms_of_one_hot_series(spark):
    rng = random.Random(9)
    rows = [("hot" if k % 7 else f"s{k}", rng.randrange(500), float(k), k * 3) for k in range(900)]
    df = points(spark, rows)
    plain = lambda d, c: {(r.series_id, r.arrival): r[c] for r in d.collect()}
    for block in (10, 100, 5000):
        assert plain(ingest.append(df, block=block), "place") == plain(ingest.append(df), "place")
        assert plain(merge.run_split(df, block=block), "run") == plain(merge.run_split(df), "run")
        assert plain(chunks.split_large(df, 9, "arrival", block=block), "part") == plain(chunks.split_large(df, 9, "arrival"), "part")
        merged = df.withColumn("stream", F.col("arrival") % 5)
        assert plain(merge.kway_merge(merged, block=block), "place") == plain(merge.kway_merge(merged), "place")


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from strandline import session

    conf = SimpleNamespace(get=lambda *a: None, set=lambda *a: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda k: None)))
    with pytest.raises(RuntimeError):
        session.scratch(cluster, "x")


def test_tags(spark):
    t = spark.createDataFrame([("k", "x", "1"), ("k", "y", "2"), ("j", "x", "1"), ("j", "z", "2"), ("j", "z", "3")], "tag_key string, tag_value string, series_id string")
    ids = lambda df: sorted(r.series_id for r in df.collect())
    assert ids(tags.exact(t, "k", "x")) == ["1"]
    assert ids(tags.any_of(t, [("k", "x"), ("j", "z")])) == ["1", "2", "3"]
    assert ids(tags.all_of(t, [("k", "y"), ("j", "z"), ("j", "z")])) == ["2"]
    assert ids(tags.none_of(t, [("k", "x")])) == ["2", "3"]
    assert ids(tags.regex(t, "k", "^[xy]$")) == ["1", "2"]
    numbers = tags.dictionary(t)
    assert sorted(r.series_no for r in numbers.collect()) == [0, 1, 2]
    assert {(r.tag_key, r.tag_value): r.n_series for r in tags.posting_counts(tags.postings(t, numbers)).collect()} == {("k", "x"): 1, ("k", "y"): 1, ("j", "x"): 1, ("j", "z"): 2}


def test_expiry(spark):
    df = spark.createDataFrame([("a", t, 0.0) for t in (0, 5, 10)], model.POINT)
    assert sorted(times(chunks.expire(df, 5))) == [5, 10]
    assert sorted(times(chunks.expire(df, 5, now_ns=20))) == []
    assert chunks.expire(df.limit(0), 5).count() == 0


def test_generator_covers_all_series(spark):
    got = generator.points(spark, 5000, n_series=103, workers=10)
    assert got.select("series_id").distinct().count() == 103  # none is left out although 103 is no multiple of 10
    assert generator.points(spark, 50, n_series=3, workers=10).select("series_id").distinct().count() <= 3


def test_stream_persist_and_admission(spark, tmp_path):
    src = f"{tmp_path}/in"
    points(spark, [("a", 1, 1.0, 0), ("a", 3, 1.0, 1), ("a", 2, 1.0, 2)]).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(model.WRITE).parquet(src)
    e = Engine(spark, f"file://{tmp_path}/out", "direct-compress")
    streaming.persist_loop(stream, e, f"{tmp_path}/cp", every=None).awaitTermination()
    assert times(Engine(spark, f"file://{tmp_path}/out", "direct-compress").read("a")) == [1, 3, 2]
    again = Engine(spark, f"file://{tmp_path}/out", "direct-compress")
    streaming.persist_loop(stream, again, f"{tmp_path}/other", every=None).awaitTermination()  # batch 0 of the loop comes again
    assert again.read("a").count() == 3
    run = lambda: streaming.admit_stream(spark.readStream.schema(model.WRITE).parquet(src)).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp2").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/admitted").awaitTermination()
    run()
    points(spark, [("a", 3, 1.0, 3), ("a", 4, 1.0, 4)]).coalesce(1).write.mode("append").parquet(src)
    run()  # state outlives the query
    got = spark.read.parquet(f"{tmp_path}/admitted").orderBy("arrival").collect()
    assert [r.status for r in got] == ["OK", "OK", "OUT_OF_ORDER", "DUPLICATE", "OK"]


def test_read_is_pushed_down(spark, tmp_path):
    path = f"{tmp_path}/p"
    spark.createDataFrame([("a", 1, 1.0), ("b", 2, 2.0)], model.POINT).write.parquet(path)
    df = read.range_read(read.read_batch(spark.read.parquet(path), ["a"]), 0, 9).select("value")
    assert "EqualTo(series_id,a)" in df._jdf.queryExecution().executedPlan().toString()
