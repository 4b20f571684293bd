"""Best-fit packing with bound-certified repacking.

Documents become token pieces of at most `capacity`; pieces are dealt to partitions of a few thousand, each packed by best-fit
decreasing. A dual-feasible-function bound gives the fewest bins a partition's lengths can need. A partition that meets it is
certified and gives up its emptiest bin at most, which holds the bound's rounding; one with a gap gives up all bins that are not
full enough. Those pieces are dealt anew into fewer partitions and packed again, until one partition is left or a round takes
up too little; what is then packed above its bound is marked. certify() holds the whole result against the bound of all lengths."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, slices, table
from .linking import groups

CAPACITY, END, GROUP = 4096, 1, 2000
_HARD = re.compile(r"[\x1c-\x1f]")
_HIGH = re.compile(r"[^\x00-˿]")
_ENDED = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)")
_LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
#: The characters that stand for bytes in a byte-level vocabulary: printable ones themselves, the others in order from U+0100.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTES = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_CACHE, _CACHE_IDS, _CACHE_CHARS = 700_000, 8_000_000, 32_000_000  # words, their ids and their characters kept at most


class _Places(dict):
    """Word -> number; a new word gets the next one and waits in `pending`."""

    pending: list[str]
    chars = 0

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        self.chars += len(word)
        self.pending.append(word)
        return k


class Encoder:
    """Token ids of whole texts. The vocabulary's pre-tokenizer drops white space and its normaliser works within a word, so a
    text's ids are those of its words, kept for a bounded number of words; it also cuts letters from signs, so the ids of letters
    and the signs that end them are kept apart. Below U+0300 lower-casing commutes with the normaliser, and words are kept in
    lower case; control characters that only Python counts as white space take the plain way. With specials so do texts that
    hold a special token, by the tokenizer as loaded; else special tokens written in a text are read as its characters."""

    def __init__(self, path: str, specials: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a word in lower case may look like a special token that its text lacks
        self.loaded = Tokenizer.from_file(path)
        added = self.loaded.get_added_tokens_decoder().values() if specials else []
        self.special = re.compile("|".join(re.escape(t.content) for t in added), re.IGNORECASE if any(t.normalized for t in added) else 0) if added else None
        self.model = self.tokenizer.model.tokenize
        probe = ["a", "theerth", "où", "straße", "éêèçàùÿ", "ñandú" * 9]
        self.direct = [self._word(w) for w in probe] == [self.tokenizer.encode(w, add_special_tokens=False).ids for w in probe]
        self.reset()

    def _word(self, word: str) -> list[int]:
        """Ids of a word of plain lower-case letters, which the normaliser and pre-tokenizer leave as it is: the model alone, on
        the characters that stand for its bytes. Only used where probes show that the vocabulary works so."""
        return [t.id for t in self.model(word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES))]

    def reset(self) -> None:
        self.place = _Places()
        self.place.pending = []
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)  # of each word in ids
        self.ids, self.n_ids = np.zeros(1 << 18, np.uint32), 0

    def _store(self, places: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.start[places], self.size[places] = self.n_ids + np.cumsum(sizes) - sizes, sizes
        self.n_ids += len(flat)

    def _gather(self, w: np.ndarray) -> np.ndarray:
        begin, sizes = self.start[w], self.size[w]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(begin - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def _learn(self) -> None:
        place, plain, joined, letters_only = self.place, [], [], []
        while place.pending:  # the parts of a word may be new themselves
            new, place.pending = place.pending, []
            for w in new:
                m = _ENDED.fullmatch(w)
                if m:
                    joined.append((place[w], place[m[1]], place[m[2]]))
                else:
                    (letters_only if self.direct and _LETTERS.fullmatch(w) else plain).append(w)
        while len(place) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        for words_, encode in ((plain, lambda part: [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]), (letters_only, lambda part: list(map(self._word, part)))):
            self._encode_new(words_, encode)
        if joined:
            words, letters, signs = np.array(joined).T
            both = np.stack([letters, signs], 1).ravel()
            self._store(words, self.size[letters] + self.size[signs], self._gather(both))

    def _encode_new(self, words: list[str], encode) -> None:
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            got = encode(part)
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            self._store(np.fromiter(map(self.place.__getitem__, part), np.int64, len(part)), sizes, np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.place) > _CACHE or self.n_ids > _CACHE_IDS or self.place.chars > _CACHE_CHARS:
            self.reset()
        get, rows = self.place.__getitem__, []
        for t in texts:
            if _HARD.search(t) or self.special and self.special.search(t):
                rows.append(None)
                continue
            words = (t if _HIGH.search(t) else t.lower()).split()
            rows.append(np.fromiter(map(get, words), np.int64, len(words)))
        self._learn()
        whole = self.loaded if self.special else self.tokenizer
        return [np.array(whole.encode(t, add_special_tokens=False).ids, np.uint32) if w is None else self._gather(w) for t, w in zip(texts, rows, strict=True)]


@lru_cache(maxsize=1)
def _encoder(path: str, specials: bool = False) -> Encoder:
    """One for all tasks of a Python worker; what it keeps is bounded and does not change its results."""
    return Encoder(path, specials)


def vocabulary(path: str | None = None) -> str:
    """The tokenizer's file: a parameter; by default word_bpe_49k of the installed public vocabularies."""
    import public_tokenizers

    return path or public_tokenizers.path("word_bpe_49k.json")


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = True, specials: bool = False) -> DataFrame:
    """One row per piece of at most `capacity` ids of each row's text and the closing id: id, piece, start, length, ids_crc32,
    ids if asked for. Null and empty texts have the closing id alone; repeated rows each have their pieces; no rows give none.
    With specials, special tokens written in a text are one id each, as the tokenizer as loaded has it; else its characters' ids."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = _encoder(path, specials)
        for b in slices(batches, 512):
            rows, piece, start, size, crc, held = [], [], [], [], [], []
            for i, ids in enumerate(encode([t or "" for t in b.column(1).to_pylist()])):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                for k, s in enumerate(range(0, len(ids), capacity)):
                    part = ids[s : s + capacity]
                    rows.append(i)
                    piece.append(k)
                    start.append(s)
                    size.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    held.append(part)
            cols = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(held).astype(np.int32) if held else np.zeros(0, np.int32))))
            yield pa.RecordBatch.from_arrays(cols, [id_col, "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """Bin of each length, and each bin's fill: longest first, into the fullest bin it fits."""
    bins, fill = np.empty(len(lengths), np.int64), []
    open_: list[tuple[int, int]] = []  # (room, bin), sorted
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        k = bisect_left(open_, (n, -1))
        if k < len(open_):
            room, b = open_.pop(k)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i] = b
        fill[b] += n
        if room > n:
            insort(open_, (room - n, b))
    return bins, fill


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Fewest bins by dual feasible functions: volume; the Martello-Toth functions (over capacity - t counts whole, under t
    nothing) for every t up to half; and the rounding functions floor((k + 1) x) / k for k = 1..20, x itself where whole."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """lower_bound of so many pieces of each length from 0 to capacity."""
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    above, volume = np.cumsum(count[::-1])[::-1], np.concatenate([[0], np.cumsum(count * size)])
    t = np.arange(1, capacity // 2 + 1)
    big = above[np.minimum(capacity - t + 1, capacity)]
    middle = volume[capacity - t + 1] - volume[t]
    best = max(best, int((big + -(-middle // capacity)).max()))
    for k in range(1, 21):
        scaled = (k + 1) * size
        whole = scaled % capacity == 0
        value = np.where(whole, size * k, scaled // capacity * capacity)  # of k * capacity
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


ADDED = ["sequence_id", "offset", "certified"]


def pack(pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY, group: int = GROUP, full: float = 0.995) -> DataFrame:
    """Rows of pieces with sequence_id, offset (gapless from 0 in each sequence) and certified: whether the row's partition, when
    it was packed for good, met the bound of its lengths.

    Rows are dealt by the number of their place in the table and a salt, about `group` to a partition, whatever they hold, so
    repeated rows spread. Bins filled to `full` stay in any round; the rest of an uncertified partition's bins are exchanged for
    as long as a round takes up a tenth of what is left. Input columns named sequence_id, offset or certified are replaced. No
    rows give no rows. Lengths from 1 to capacity are expected; null lengths and lengths out of that range raise."""
    pieces = pieces.drop(*[c for c in pieces.columns if c in ADDED])
    if length_col not in pieces.columns:
        raise ValueError(f"no column {length_col!r} of lengths")
    names = pieces.columns
    part_col = "__grp"
    while part_col in names:
        part_col += "_"
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    # Rows packed together at most, and numbers for the bins of a partition: its rows are binomial around `group`.
    most, room = 4 * group, 64 * group
    done_parts, left, before, turn, used = [], cut(pieces, "pieces"), None, 0, 0
    while n_now := left.count():
        n_groups = max(1, -(-n_now // group))
        last = n_groups == 1 or before is not None and n_now > 0.9 * before
        before = n_now
        dealt = left.withColumn(part_col, F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(n_groups)).cast("bigint")).select(part_col, *[F.col(f"`{c}`") for c in names])

        def run(batches: Iterator[pa.RecordBatch], first=used, last=last) -> Iterator[pa.RecordBatch]:
            for whole in groups(batches, 1):
                number = first + whole.column(part_col)[0].as_py() * room
                if whole.num_rows > room:
                    raise ValueError("a partition holds more rows than it has numbers")
                for i in range(0, whole.num_rows, most):
                    t = whole.slice(i, most)
                    lengths = t.column(length_col).to_numpy()
                    if t.column(length_col).null_count or lengths.min() < 1 or lengths.max() > capacity:
                        raise ValueError("a length is null or out of range")
                    bins, fill = best_fit_decreasing(lengths, capacity)
                    met = len(fill) == lower_bound(lengths, capacity)
                    stays = np.ones(len(fill), bool)
                    if not last and not met:
                        stays = np.array(fill) >= full * capacity
                    elif not last and min(fill) < full * capacity:
                        stays[int(np.argmin(fill))] = False
                    order = np.argsort(bins, kind="stable")
                    ends = np.cumsum(lengths[order])
                    heads = np.concatenate([[0], np.flatnonzero(np.diff(bins[order])) + 1])
                    base = np.repeat(np.concatenate([[0], ends])[heads], np.diff(np.append(heads, len(order))))
                    offset = np.empty(len(order), np.int64)
                    offset[order] = ends - lengths[order] - base
                    sequence, kept = number + bins, stays[bins]
                    number += len(fill)
                    t = t.drop_columns([part_col]).append_column("sequence_id", pa.array(sequence, mask=~kept)).append_column("offset", pa.array(offset, mask=~kept)).append_column("certified", pa.array(np.full(len(bins), met)))
                    yield from t.combine_chunks().to_batches()

        packed = dealt.repartition(part_col).sortWithinPartitions(part_col).mapInArrow(run, f"{kinds}, sequence_id bigint, offset bigint, certified boolean")
        packed = cut(packed, "packed")
        drop(left)
        done_parts.append(packed.where("sequence_id is not null"))
        left = packed.where("sequence_id is null").select(*[F.col(f"`{c}`") for c in names])
        used += n_groups * room
        turn += 1
        if last:
            break
    if not done_parts:
        return pieces.withColumns({"sequence_id": F.lit(None).cast("bigint"), "offset": F.lit(None).cast("bigint"), "certified": F.lit(None).cast("boolean")})
    out = done_parts[0]
    for p in done_parts[1:]:
        out = out.unionByName(p)
    return out


def certify(packed: DataFrame, length_col: str = "length", capacity: int = CAPACITY) -> tuple[int, int]:
    """Sequences of a packing, and the dual-feasible bound of all its lengths: the fewest that any packing has. Lengths are
    counted on the executors; at most `capacity` counts come to the driver."""
    counts = packed.groupBy(F.col(length_col).alias("n")).agg(F.count(F.lit(1)).alias("times")).collect()
    count = np.zeros(capacity + 1, np.int64)
    for r in counts:
        count[r["n"]] = r["times"]
    return packed.select("sequence_id").distinct().count(), bound_of_counts(count, capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False, specials=True))
