"""Lossless point codec after the Gorilla paper: delta-of-delta timestamps and XOR-ed doubles, with resumable state.

Own layout. Each point starts with a 1 bit; a 0 bit or the end of the bytes ends a stream, so zero padding is harmless. The first
timestamp takes 64 bits; later ones store the zigzag delta of deltas (modulo 2**64, so any order is lossless) in the smallest of
CLASSES, each with a unary prefix. A value is XOR-ed with its predecessor: '0' if equal; '10' and the predecessor's meaningful
window if the XOR fits the window the predecessor's own XOR had; else '11', 6 bits of leading zeros, 6 bits of length - 1, and the
meaningful bits. As that window depends on two neighbours only, encoding is a handful of array operations."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Payload bits of the delta-of-delta classes; class k has the prefix of k ones and a zero, the last one no zero.
CLASSES = [0, 7, 14, 24, 36, 64]


class CodecError(ValueError):
    """A stream that ends inside a point."""


def _bit_length(x: np.ndarray) -> np.ndarray:
    """Bits of each unsigned 64-bit integer."""
    high, low = (x >> np.uint64(32)).astype(np.float64), (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1])


def _trailing(x: np.ndarray) -> np.ndarray:
    """Trailing zeros of each non-zero unsigned integer."""
    with np.errstate(over="ignore"):
        return _bit_length(x & (~x + np.uint64(1))) - 1


def _pack(fields: list[tuple[np.ndarray, np.ndarray]], carry: tuple[int, int]) -> tuple[bytes, int]:
    """Bits of the fields (values, widths), point by point in field order, after `carry` (bits, count); most significant first.
    Returns the bytes and the total number of bits."""
    values, widths = np.stack([v for v, _ in fields], 1).ravel(), np.stack([w for _, w in fields], 1).ravel()
    total = int(widths.sum())
    index = np.repeat(np.arange(len(widths)), widths)
    within = np.arange(total) - np.repeat(np.cumsum(widths) - widths, widths)
    bits = (values[index] >> (widths[index] - 1 - within).astype(np.uint64)) & np.uint64(1)
    held = np.array([(carry[0] >> (carry[1] - 1 - k)) & 1 for k in range(carry[1])], np.uint8)
    bits = np.concatenate([held, bits.astype(np.uint8)])
    return np.packbits(bits).tobytes(), len(bits)


class Encoder:
    """Encodes batches of points; state() and restore() resume a stream without its earlier bytes."""

    def __init__(self) -> None:
        self.n, self.ts, self.delta, self.bits, self.window = 0, 0, 0, 0, (0, 0)
        self.last, self.used = 0, 0  # the partial last byte and its used bits

    def encode(self, ts: np.ndarray, values: np.ndarray) -> bytes:
        """The bytes these points complete, ended by the partial last byte if there is one (see state)."""
        n = len(ts)
        if not n:
            return bytes([self.last]) if self.used else b""
        t = np.concatenate([[self.ts], np.asarray(ts, np.int64)]).view(np.uint64)
        v = np.concatenate([np.array([self.bits], np.uint64), np.asarray(values, np.float64).view(np.uint64)])
        one, zero = np.ones(n, np.uint64), np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            delta = np.diff(t)
            if not self.n:
                delta[0] = 0
            dod = np.diff(np.concatenate([np.array([self.delta], np.uint64), delta])).view(np.int64)
            zigzag = (dod.view(np.uint64) << np.uint64(1)) ^ (dod >> np.int64(63)).view(np.uint64)
        need = _bit_length(zigzag)
        cls = np.searchsorted(CLASSES, need)
        last = len(CLASSES) - 1
        prefix_width = np.where(cls < last, cls + 1, last)
        prefix = np.where(cls < last, (np.uint64(1) << (cls + 1).astype(np.uint64)) - np.uint64(2), np.uint64((1 << last) - 1))
        payload, payload_width = zigzag, np.array(CLASSES)[cls]
        if not self.n:  # the first timestamp whole
            prefix_width, payload, payload_width = prefix_width.copy(), payload.copy(), payload_width.copy()
            prefix_width[0], payload[0], payload_width[0] = 0, t[1], 64
        xor = v[1:] ^ v[:-1]
        same = xor == 0
        lead, trail = 64 - _bit_length(xor), _trailing(np.where(same, np.uint64(1), xor))
        prev_lead, prev_trail = np.concatenate([[self.window[0]], lead[:-1]]), np.concatenate([[self.window[1]], trail[:-1]])
        prev_same = np.concatenate([[self.n == 0 or self.window == (64, 0)], same[:-1]])
        fits = ~same & ~prev_same & (lead >= prev_lead) & (trail >= prev_trail) & (64 - prev_lead - prev_trail <= 12 + 64 - lead - trail)
        use_lead, use_trail = np.where(fits, prev_lead, lead), np.where(fits, prev_trail, trail)
        size = np.where(same, 0, 64 - use_lead - use_trail)
        control = np.where(same, 0, np.where(fits, 2, 3)).astype(np.uint64)
        head = np.where(fits | same, np.uint64(0), ((lead % 64).astype(np.uint64) << np.uint64(6)) | (np.maximum(size, 1) - 1).astype(np.uint64))
        fields = [
            (one, np.ones(n, np.int64)), (prefix, prefix_width), (payload, payload_width), (control, np.where(same, 1, 2)),
            (head, np.where(fits | same, 0, 12)), (np.where(same, zero, xor >> use_trail.astype(np.uint64)), size),
        ]
        out, total = _pack(fields, (self.last >> (8 - self.used) if self.used else 0, self.used))
        self.n += n
        self.ts, self.delta, self.bits = int(np.int64(t.view(np.int64)[-1])), int(delta[-1]), int(v[-1])
        self.window = (64, 0) if same[-1] else (int(lead[-1]), int(trail[-1]))
        self.used = total % 8
        self.last = out[-1] if self.used else 0
        return out

    def last_encoded(self) -> tuple[int, float] | None:
        return (self.ts, float(np.uint64(self.bits).view(np.float64))) if self.n else None

    def state(self) -> str | None:
        """JSON; null if nothing was written."""
        return json.dumps([self.n, self.ts, self.delta, self.bits, *self.window, self.last, self.used]) if self.n else None

    @classmethod
    def restore(cls, state: str | None) -> Encoder:
        e = cls()
        if state is not None:
            e.n, e.ts, e.delta, e.bits, lead, trail, e.last, e.used = json.loads(state)
            e.window = (lead, trail)
        return e


def join(first: bytes, second: bytes, used: int) -> bytes:
    """The stream of `first`, whose last byte is partial if used > 0, and what a restored encoder made next."""
    return (first[:-1] if used else first) + second


def decode_stream(data: bytes, state: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Timestamps and values in the order of writing; `state` is that of the encoder before these bytes."""
    lane = _start(state)
    ts, bits = _decode_on(data, lane)
    return np.array(ts, np.uint64).view(np.int64), np.array(bits, np.uint64).view(np.float64)


def _start(state: str | None) -> tuple[int, int, int, int, int, int, int]:
    """(points before, time, delta, value bits, lead, trail, bit to start at) of a decoder."""
    if state is None:
        return 0, 0, 0, 0, 0, 0, 0
    n, t, delta, v, lead, trail, _, used = json.loads(state)
    return n, t & _MASK, delta, v, lead, trail, used


_MASK = (1 << 64) - 1


def _decode_on(data: bytes, lane: tuple[int, int, int, int, int, int, int]) -> tuple[list[int], list[int]]:
    n, t, delta, v, lead, trail, at = lane
    total = 8 * len(data)
    ts: list[int] = []
    bits: list[int] = []
    # A window of the stream is held as one integer, so reading a field costs no more late in a long stream than early.
    base, span, word = 0, 0, 0

    def take(k: int) -> int:
        nonlocal at, base, span, word
        if at + k > total:
            raise CodecError("the stream ends inside a point")
        if at + k > base + span:
            first = at // 8
            piece = data[first : first + 256]
            base, span, word = 8 * first, 8 * len(piece), int.from_bytes(piece, "big")
        out = (word >> (base + span - at - k)) & ((1 << k) - 1)
        at += k
        return out

    while at < total:
        if not take(1):
            break
        if not n:
            t = take(64)
        else:
            cls = 0
            while cls < len(CLASSES) - 1 and take(1):
                cls += 1
            z = take(CLASSES[cls])
            delta = (delta + ((z >> 1) ^ -(z & 1))) & _MASK
            t = (t + delta) & _MASK
        n += 1
        if take(1):
            if take(1):
                lead = take(6)
                size = take(6) + 1
                trail = 64 - lead - size
            else:
                size = 64 - lead - trail
            x = take(size) << trail
            v ^= x
            lead, trail = 64 - x.bit_length(), (x & -x).bit_length() - 1  # the window the next point may use
        ts.append(t)
        bits.append(v)
    return ts, bits


_TOGETHER = 64  # streams that are stepped together at least; fewer are decoded one by one
_ONES = np.array([5 if k == 31 else (~k & 31).bit_length() and 5 - (~k & 31).bit_length() for k in range(32)])  # leading ones of five bits


def decode_many(data: list[bytes], states: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points of each stream, and the timestamps and values of all, stream by stream.

    Streams are stepped together, a point of each at a time, by array operations; the last few long ones go on alone."""
    n = len(data)
    lanes = np.array([_start(s) for s in states], dtype=object).reshape(n, 7)
    seen, at = lanes[:, 0].astype(np.int64), lanes[:, 6].astype(np.int64)
    t, delta, v = (lanes[:, k].astype(np.uint64) for k in (1, 2, 3))
    lead, trail = lanes[:, 4].astype(np.int64), lanes[:, 5].astype(np.int64)
    sizes = np.array([len(d) for d in data], np.int64)
    origin = 8 * (np.cumsum(sizes + 32) - sizes - 32)  # zeros after each stream: a field that runs over its end is read, then refused
    at, end = at + origin, origin + 8 * sizes
    raw = np.frombuffer(b"".join(d + bytes(32) for d in data), np.uint8)
    words = np.zeros(max(len(raw) - 8, 0), np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | raw[k : k + len(words)]
    payload = np.array(CLASSES)
    out_lane, out_t, out_v = [], [], []
    live = np.arange(n)

    def take(k: np.ndarray) -> np.ndarray:
        """k bits (0 to 64) of each live stream."""
        p = at[live]
        byte, shift = p >> 3, (p & 7).astype(np.uint64)
        w = (words[byte] << shift) | (raw[byte + 8].astype(np.uint64) >> (np.uint64(8) - shift))
        at[live] = p + k
        return np.where(k > 0, w >> (64 - np.maximum(k, 1)).astype(np.uint64), np.uint64(0))

    with np.errstate(over="ignore"):
        while len(live) >= _TOGETHER:
            live = live[at[live] < end[live]]
            one = np.ones(len(live), np.int64)
            live = live[take(one) > 0]
            if not len(live):
                break
            new = seen[live] == 0
            cls = _ONES[take(np.full(len(live), 5)).astype(np.int64)]
            prefix = np.minimum(cls + 1, 5)
            at[live] -= np.where(new, 5, 5 - prefix)
            z = take(np.where(new, 64, payload[cls]))
            change = (z >> np.uint64(1)) ^ (np.uint64(0) - (z & np.uint64(1)))
            delta[live] = np.where(new, delta[live], delta[live] + change)
            t[live] = np.where(new, z, t[live] + delta[live])
            seen[live] += 1
            two = take(np.full(len(live), 2)).astype(np.int64)
            same, header = two < 2, two == 3
            at[live] -= same  # a value equal to the one before has one control bit
            head = take(np.where(header, 12, 0)).astype(np.int64)
            own_lead = np.where(header, head >> 6, lead[live])
            own_trail = np.where(header, 64 - (head >> 6) - (head & 63) - 1, trail[live])
            x = take(np.where(same, 0, 64 - own_lead - own_trail)) << np.where(same, 0, own_trail).astype(np.uint64)
            v[live] ^= x
            some = ~same
            changed = live[some]
            lead[changed], trail[changed] = 64 - _bit_length(x[some]), _trailing(x[some])
            if (at[live] > end[live]).any():
                raise CodecError("the stream ends inside a point")
            out_lane.append(live)
            out_t.append(t[live])
            out_v.append(v[live])
    for i in live.tolist():
        ts, bits = _decode_on(data[i], (int(seen[i]), int(t[i]), int(delta[i]), int(v[i]), int(lead[i]), int(trail[i]), int(at[i] - origin[i])))
        out_lane.append(np.full(len(ts), i))
        out_t.append(np.array(ts, np.uint64))
        out_v.append(np.array(bits, np.uint64))
    if not out_lane:
        return np.zeros(n, np.int64), np.zeros(0, np.int64), np.zeros(0)
    lane = np.concatenate(out_lane)
    order = np.argsort(lane, kind="stable")
    return np.bincount(lane, minlength=n), np.concatenate(out_t)[order].view(np.int64), np.concatenate(out_v)[order].view(np.float64)


PART_POINTS = 1 << 20


def encode(points: DataFrame, order: list[str] | str = "arrival", chunk: str | None = None, most_points: int = PART_POINTS, block: int | None = None) -> DataFrame:
    """(series_id[, chunk], part, data, n_points, nulls, state): one stream per series and chunk, points in `order`,
    those of equal order by time, then value, those of no order last.

    A stream longer than most_points goes on in further parts, each a stream of its own, so no task holds a whole series. With
    `block`, parts are also cut at multiples of that many values of the first order column, and are dealt to tasks one by one, so
    a hot series is not one task's. Parts of a series are in order; their numbers may have gaps. No points give no rows."""
    order = [order] if isinstance(order, str) else order
    keys = ["series_id", *([chunk] if chunk else [])]
    first = F.floor(F.col(order[0]) / block).cast("bigint") if block else F.lit(0).cast("bigint")
    rows = points.select(*keys, (first * F.lit(1 << 20)).alias("__part"), *[F.col(c).alias(f"__o{k}") for k, c in enumerate(order)], "ts_nanos", "value")
    by = [*keys, "__part"]
    picked = rows.repartition(*by).sortWithinPartitions(*by, *map(F.asc_nulls_last, [*(f"__o{k}" for k in range(len(order))), "ts_nanos", "value"])).select(*by, "ts_nanos", "value", F.lit(None).cast("string").alias("state"))
    return _encoded(picked, keys, most_points, fresh=True).drop("before")


def encode_from(points: DataFrame, states: DataFrame, order: str = "arrival", most_points: int = PART_POINTS) -> DataFrame:
    """(series_id, part, data, n_points, nulls, before, state): segments that continue the series' streams from saved states alone
    (series_id, part, state; series without one begin). `before` is the state a segment is decoded from, its first byte holds the
    bits that the one before it left over, and parts count on."""
    new = points.select("series_id", F.lit(0).cast("bigint").alias("__part"), F.col(order).alias("__o"), "ts_nanos", "value", F.lit(None).cast("string").alias("state"))
    held = states.select("series_id", (F.col("part") + 1).alias("__part"), F.lit(None).cast(points.schema[order].dataType).alias("__o"), F.lit(None).cast("bigint").alias("ts_nanos"), F.lit(None).cast("double").alias("value"), "state")
    rows = new.unionByName(held).repartition("series_id").sortWithinPartitions("series_id", *map(F.asc_nulls_last, ("state", "__o", "ts_nanos", "value")))
    return _encoded(rows.select("series_id", "__part", "ts_nanos", "value", "state"), ["series_id"], most_points, fresh=False)


def _encoded(rows: DataFrame, keys: list[str], most_points: int, fresh: bool) -> DataFrame:
    """Encodes rows (keys, __part, ts_nanos, value, state) sorted by keys: a row with a state comes first of its series and is no
    point. fresh: each part is a stream of its own; else a part goes on from the one before.

    A null time or value is 0 in the stream; nulls has a bit for each null time, then for each null value (null: there are none)."""
    from pyspark.sql.pandas.types import to_arrow_type

    k_ = len(keys)
    names = [*keys, "part", "data", "n_points", "nulls", "before", "state"]
    kinds = [*(to_arrow_type(rows.schema[k].dataType) for k in keys), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.string(), pa.string()]
    types = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]
        ts: list[np.ndarray] = []
        values: list[np.ndarray] = []
        nulls: list[np.ndarray] = []
        key, part, encoder, held = None, 0, Encoder(), 0

        def emit() -> None:
            nonlocal part, encoder, held
            if not held:
                return
            before = encoder.state()
            data = encoder.encode(np.concatenate(ts), np.concatenate(values))
            null = np.concatenate(nulls, axis=1)
            for c, x in zip(out, [*key, part, data, held, np.packbits(null).tobytes() if null.any() else None, before, encoder.state()], strict=True):
                c.append(x)
            ts.clear()
            values.clear()
            nulls.clear()
            part, held = part + 1, 0
            if fresh:
                encoder = Encoder()

        def made() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
            for c in out:
                c.clear()
            return b

        same = k_ + 1 if fresh else k_  # columns that tell streams apart
        for b in batches:
            if not b.num_rows:
                continue
            change = np.zeros(b.num_rows, bool)
            for c in b.columns[:same]:
                codes = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                change[1:] |= codes[1:] != codes[:-1]
            state = b.column(k_ + 3)
            times, numbers = b.column(k_ + 1).fill_null(0).to_numpy(), b.column(k_ + 2).fill_null(0).to_numpy()
            gone = np.stack([b.column(c).is_null().to_numpy(zero_copy_only=False) for c in (k_ + 1, k_ + 2)])
            starts = [0, *np.flatnonzero(change).tolist()]
            for i, j in zip(starts, [*starts[1:], b.num_rows], strict=True):
                own = [c[i].as_py() for c in b.columns[:same]]
                if own[:k_] + ([own[k_]] if fresh else []) != (None if key is None else [*key] + ([base] if fresh else [])):
                    emit()
                    key, base, part, encoder = own[:k_], own[k_] if fresh else 0, b.column(k_)[i].as_py(), Encoder()
                    if state[i].is_valid:
                        encoder = Encoder.restore(state[i].as_py())
                        i += 1
                while i < j:
                    n = min(j - i, most_points - held)
                    ts.append(times[i : i + n])
                    values.append(numbers[i : i + n])
                    nulls.append(gone[:, i : i + n])
                    held += n
                    i += n
                    if held >= most_points:
                        emit()
            if len(out[0]) >= 1024 or sum(map(len, out[k_ + 1])) > 1 << 24:
                yield made()
        emit()
        if out[0]:
            yield made()

    return rows.mapInArrow(run, ", ".join([*types, "part bigint", "data binary", "n_points bigint", "nulls binary", "before string", "state string"]))


def decode(streams: DataFrame, chunk: str | None = None) -> DataFrame:
    """(series_id[, chunk], place, ts_nanos, value) of each stream, place from 1 in the stream's order, counted on over the parts
    of streams that have any (columns part and n_points). A column `before` holds states that segments are decoded from, a column `nulls` which times and
    values are null (see _encoded)."""
    keys = ["series_id", *([chunk] if chunk else [])]
    types = [f"`{k}` {streams.schema[k].dataType.simpleString()}" for k in keys]
    earlier = F.lit(0).cast("bigint")
    if {"part", "n_points"} <= set(streams.columns):
        over = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        earlier = F.coalesce(F.sum("n_points").over(over), F.lit(0)).cast("bigint")
    before = F.col("before") if "before" in streams.columns else F.lit(None).cast("string")
    nulls = F.col("nulls") if "nulls" in streams.columns else F.lit(None).cast("binary")
    k_ = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.array([len(x) if (x := d.as_buffer()) is not None else 0 for d in b.column(k_)], np.int64)
            group = (np.cumsum(sizes) - sizes) >> 21  # about two megabytes of streams are decoded together
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                part = b.slice(i, j - i)
                counts, ts, values = decode_many([d or b"" for d in part.column(k_).to_pylist()], part.column(k_ + 1).to_pylist())
                row = np.repeat(np.arange(j - i), counts)
                place = np.arange(len(ts)) - np.repeat(np.cumsum(counts) - counts, counts) + 1 + part.column(k_ + 2).to_numpy()[row]
                gone = np.zeros((2, len(ts)), bool)
                for x, n, end in zip(part.column(k_ + 3).to_pylist(), counts, np.cumsum(counts), strict=True):
                    if x is not None:
                        gone[:, end - n : end] = np.unpackbits(np.frombuffer(x, np.uint8), count=2 * n).reshape(2, n)
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(row)) for k in range(k_)), pa.array(place), pa.array(ts, mask=gone[0]), pa.array(values, mask=gone[1])], [*keys, "place", "ts_nanos", "value"])

    return streams.select(*keys, "data", before.alias("before"), earlier.alias("earlier"), nulls.alias("nulls")).mapInArrow(run, ", ".join([*types, "place bigint", "ts_nanos bigint", "value double"]))


def encode_resumed(first: DataFrame, second: DataFrame, order: str = "arrival", most_points: int = PART_POINTS) -> DataFrame:
    """Streams of `first` continued by `second` from saved states alone: all parts of the first half, and segments that go on from
    the state of its last part (see encode_from)."""
    half = encode(first, order, most_points=most_points)
    states = half.groupBy("series_id").agg(F.max(F.struct("part", "state")).alias("s")).select("series_id", "s.part", "s.state")
    return half.withColumn("before", F.lit(None).cast("string")).unionByName(encode_from(second, states, order, most_points))
