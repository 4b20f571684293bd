import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.functions import codec

I64 = st.integers(-(2**63), 2**63 - 1)
BITS = st.one_of(st.integers(0, 2**64 - 1), st.sampled_from([0, 1 << 63, 0x7FF0 << 48, 0xFFF0 << 48, 0x7FF8 << 48, 0x7FF8000000000001, 1]))


def arrays(points):
    return np.array([t for t, _ in points], np.int64), np.array([b for _, b in points], np.uint64).view(np.float64)


def same(data, points):
    ts, values = codec.decode_stream(data)
    return ts.tolist() == [t for t, _ in points] and values.view(np.uint64).tolist() == [b for _, b in points]


def bits(values):
    return np.array(values, np.float64).view(np.uint64).tolist()


@pytest.mark.parametrize("ts", [[1, 2, 3], [3, 2, 1]])
def test_round_trip_in_write_order(ts):
    points = list(zip(ts, bits([-1.0, 0.0, 1.0]), strict=True))
    e = codec.Encoder()
    for k in range(3):  # the last point is that written last, whatever its time
        d = codec.Encoder()
        d.encode(*arrays(points[: k + 1]))
        assert d.last_encoded() == (ts[k], [-1.0, 0.0, 1.0][k])
    data = e.encode(*arrays(points))
    assert same(data, points)
    assert len(data) <= 22


def test_state_and_restore_point_by_point():
    points = list(zip([1, 2, 3], bits([-1.0, 0.0, 1.0]), strict=True))
    data, state = b"", None
    for p in points:
        e = codec.Encoder.restore(state)
        used = e.used
        data = codec.join(data, e.encode(*arrays([p])), used)
        state = e.state()
    assert same(data, points)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(I64, BITS), max_size=40), st.integers(0, 40))
def test_any_points_and_any_split(points, cut):
    whole = codec.Encoder().encode(*arrays(points)) if points else b""
    assert same(whole, points)
    e = codec.Encoder()
    first = e.encode(*arrays(points[:cut]))
    f = codec.Encoder.restore(e.state())
    used = f.used
    rest = points[cut:]
    assert (codec.join(first, f.encode(*arrays(rest)), used) if rest else first) == whole


def test_padding_ends_a_stream_and_cuts_raise():
    points = list(zip([5, 9], bits([1.5, 2.5]), strict=True))
    data = codec.Encoder().encode(*arrays(points))
    assert same(data + b"\0\0", points)
    assert codec.decode_stream(b"")[0].size == 0
    with pytest.raises(codec.CodecError):
        codec.decode_stream(data[:9])
    assert codec.Encoder().state() is None and codec.Encoder().last_encoded() is None and codec.Encoder().encode(np.array([], np.int64), np.array([])) == b""


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.lists(st.tuples(I64, BITS), max_size=12), st.integers(0, 12)), min_size=70, max_size=90))
def test_streams_decoded_together(streams):
    data, states, want = [], [], []
    for points, cut in streams:
        e = codec.Encoder()
        if points[:cut]:
            e.encode(*arrays(points[:cut]))
        states.append(e.state())
        data.append(e.encode(*arrays(points[cut:])) if points[cut:] else b"")
        states[-1] = states[-1] if points[cut:] else None
        want.append(points[cut:])
    counts, ts, values = codec.decode_many(data, states)
    assert counts.tolist() == [len(w) for w in want]
    assert ts.tolist() == [t for w in want for t, _ in w] and values.view(np.uint64).tolist() == [b for w in want for _, b in w]


def test_cut_streams_raise_together():
    whole = codec.Encoder().encode(np.arange(50), np.linspace(0, 1, 50))
    with pytest.raises(codec.CodecError):
        codec.decode_many([whole] * 79 + [whole[:-3]], [None] * 80)


def test_resumed_streams_keep_every_part(spark):
    rows = [("a", 10 - k, float(k), k) for k in range(8)] + [("b", 5, 1.0, 0), ("c", 6, 1.0, 7)]
    df = spark.createDataFrame(rows, "series_id string, ts_nanos bigint, value double, arrival bigint")
    made = codec.encode_resumed(df.where("arrival < 5"), df.where("arrival >= 5"), most_points=2)
    assert made.where("series_id = 'a'").count() == 5
    got = codec.decode(made).orderBy("series_id", "place").collect()
    assert [(r.series_id, r.ts_nanos, r.value) for r in got] == [r[:3] for r in rows]
    assert [r.place for r in got] == [*range(1, 9), 1, 1]  # places go on over the parts
    hot = codec.decode(codec.encode(df, block=3)).orderBy("series_id", "place").collect()
    assert [(r.series_id, r.ts_nanos) for r in hot] == [r[:2] for r in rows]


def test_tied_arrivals_are_encoded_by_time_and_value(spark):
    want = [("a", 5, 0.5, 0), ("a", 5, 1.0, 0), ("a", 9, 0.0, 0), ("a", 3, 0.0, 1), ("a", 1, 9.0, 6), ("a", 2, 8.0, 6), ("a", 2, 8.5, 6)]
    for rows in (want, want[::-1]):
        df = spark.createDataFrame(rows, "series_id string, ts_nanos bigint, value double, arrival bigint").coalesce(1)
        for made in (codec.encode(df), codec.encode_resumed(df.where("arrival < 5"), df.where("arrival >= 5"), most_points=2)):
            got = codec.decode(made).orderBy("place").collect()
            assert [(r.series_id, r.ts_nanos, r.value) for r in got] == [r[:3] for r in want]


def test_dataframe_codec(spark):
    rows = [("a", 3, -1.0, 0), ("a", 2, float("nan"), 1), ("a", 1, -0.0, 2), ("b", 2**62, 5e-324, 0)]
    df = spark.createDataFrame(rows, "series_id string, ts_nanos bigint, value double, arrival bigint")
    got = codec.decode(codec.encode(df)).orderBy("series_id", "place").collect()
    assert [(r.series_id, r.ts_nanos) for r in got] == [(r[0], r[1]) for r in rows]
    assert bits([r.value for r in got]) == bits([r[2] for r in rows])
    parts = codec.encode(df, most_points=2)
    assert parts.where("series_id = 'a'").count() == 2
    assert codec.decode(codec.encode(df.limit(0))).count() == 0
