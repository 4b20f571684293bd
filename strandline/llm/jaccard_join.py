"""N-gram Jaccard join by chosen paths: sets are split recursively on sampled shared tokens, small buckets are compared by
brute force, and runs repeat until the target recall.

A set is the 64-bit hashes of a text's five-word shingles, embedded as 64 min-hashes; two sets agree on one with probability
their Jaccard similarity. A run starts by splitting on one sampled position; buckets over the limit split again on two sampled
positions each (at least 1 / threshold branches, so a similar pair survives level after level), with the paths drawn from the
bucket's key, unless most of their rows agree at a drawn position: such rows are compared through leaders. The number of runs follows from the target recall at the deepest level. What meets in a bucket is screened by the
min-hashes' low bytes; candidate groups are then checked with their whole sets."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, slices, table
from .linking import Sketch, block_pairs, bucket_links, check_blocks, components, expand_pairs
from .neardup_vectors import results

HASHES, DEPTH, LIMIT = 64, 3, 128
# Of 64 bytes similarity 0.8 agrees in 51 +- 3.2, so in 34 at the least likely. Leaders absorb what differs in 5 bytes at most.
BYTES = Sketch(near=34, absorb=59)
_WORD = re.compile(r"\w+")
_CACHE, _LONG = 150_000, 40


def runs_needed(threshold: float, recall: float, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold meets at the deepest level with probability `recall`."""
    met = 1.0
    for _ in range(depth - 1):
        met = 1 - (1 - threshold * met) ** 2
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold * met))


class Shingler:
    """Sets of 64-bit shingle hashes; hashes are kept for a bounded number of words of up to _LONG characters."""

    def __init__(self, n: int) -> None:
        self.n, self.words = n, {}
        self.mult = [np.uint64(int(x) | 1) for x in np.random.default_rng(11).integers(1 << 62, 1 << 63, n, dtype=np.uint64)]

    def __call__(self, text: str) -> np.ndarray:
        """Sorted distinct hashes of the text's n-word shingles; of all its words as one if it has fewer; none without words."""
        tokens, words = _WORD.findall(text.lower()), self.words
        try:
            h = np.array([words[t] for t in tokens], np.uint64)
        except KeyError:
            if len(words) > _CACHE:
                words.clear()
            for t in tokens:
                if t not in words and len(t) <= _LONG:
                    words[t] = xxhash.xxh64_intdigest(t)
            h = np.array([words[t] if len(t) <= _LONG else xxhash.xxh64_intdigest(t) for t in tokens], np.uint64)
        if not len(h):
            return h
        n = min(self.n, len(h))
        with np.errstate(over="ignore"):
            out = np.zeros(len(h) - n + 1, np.uint64)
            for k in range(n):
                out = (out ^ (out >> np.uint64(29))) * self.mult[k] + h[k : len(h) - n + 1 + k]
            out ^= out >> np.uint64(31)
            out *= np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        return np.unique(out)


class MinHash:
    def __init__(self) -> None:
        rng = np.random.default_rng(5)
        self.xor = rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, HASHES, dtype=np.uint64)
        self.mul = rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """Rows of HASHES min-hashes; every set has a member. Sets are taken together while they have under a million members."""
        out, i = np.empty((len(sets), HASHES), np.uint64), 0
        while i < len(sets):
            j, total = i, 0
            while j < len(sets) and (j == i or total + len(sets[j]) < 1 << 17):
                total += len(sets[j])
                j += 1
            every = np.concatenate(sets[i:j])
            starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[i : j - 1]])]).astype(np.int64)
            with np.errstate(over="ignore"):
                for k in range(HASHES):
                    v = (every ^ self.xor[k]) * self.mul[k]
                    v ^= v >> np.uint64(32)
                    out[i:j, k] = np.minimum.reduceat(v, starts)
            i = j
        return out


def sketch_texts(docs: DataFrame, n: int, n_runs: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_sh, k1, k2 (digest of the set; null without words), roots (one min-hash for each run), sketch (64 low bytes)."""

    def run(batches):
        shingle, minhash = Shingler(n), MinHash()
        positions = np.random.default_rng(23).permutation(np.arange(n_runs) % HASHES)
        for b in slices(batches):
            sets = [shingle(t or "") for t in b.column(1).to_pylist()]
            some = [i for i, s in enumerate(sets) if len(s)]
            mins = minhash([sets[i] for i in some]) if some else np.zeros((0, HASHES), np.uint64)
            k1, k2, roots, sketch = ([None] * len(sets) for _ in range(4))
            for i, m in zip(some, mins, strict=True):
                d = xxhash.xxh3_128_intdigest(sets[i].tobytes())
                k1[i], k2[i] = (d >> 64) - 2**63, (d & (2**64 - 1)) - 2**63
                roots[i], sketch[i] = m[positions].view(np.int64), m.astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(roots, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], ["id", "n_sh", "k1", "k2", "roots", "sketch"])

    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, "id bigint, n_sh bigint, k1 bigint, k2 bigint, roots array<bigint>, sketch binary")


def _drawn(level: int, k: int):
    """The k-th position (0 or 1) that a bucket's key draws at a level; the two differ."""
    draw = lambda k: F.xxhash64("key", F.lit(level), F.lit(k))
    first = F.pmod(draw(0), F.lit(HASHES))
    return first if k == 0 else F.pmod(first + 1 + F.pmod(draw(1), F.lit(HASHES - 1)), F.lit(HASHES))


def _byte(position):
    return F.col("sketch").substr(position.cast("int") + 1, F.lit(1))


def _split(rows: DataFrame, level: int) -> DataFrame:
    """Two children a row: the bucket's key draws two positions, and the sketch's byte there extends the path."""
    children = [F.xxhash64("key", p, _byte(p)) for p in (_drawn(level, 0), _drawn(level, 1))]
    return rows.select(F.explode(F.array(*children)).alias("key"), "id", "sketch")


def _sets_of(joined: DataFrame, n: int) -> DataFrame:
    """Shingle sets of the representatives' texts, as bytes; rows of a repeated id whose text is of another class go."""

    def run(batches):
        shingle = Shingler(n)
        for b in slices(batches, 128):
            t = pa.Table.from_batches([b])
            sets = [shingle(x or "") for x in t.column("text").to_pylist()]
            digest = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            own = np.array([(d >> 64) - 2**63 == k for d, k in zip(digest, t.column("k1").to_pylist(), strict=True)], bool)
            t = t.drop_columns(["text", "k1"]).append_column("shingles", pa.array([s.tobytes() for s in sets], pa.binary()))
            yield from t.filter(pa.array(own)).combine_chunks().to_batches()

    return joined.mapInArrow(run, "grp bigint, id bigint, weight bigint, shingles binary")


def jaccard_links(left: list[bytes], right: list[bytes], threshold: float):
    """Jaccard similarities of the left's rows with the right's, by products of 0/1 matrices over 2048 shingles at a time that
    occur in both. Holds one number for each pair of rows and two slices of 2048 columns beside the sets."""
    one = [np.frombuffer(r, np.uint64) for r in left]
    sizes = [np.array([len(r) // 8 for r in x], np.int64) for x in (left, right)]
    sides = [one, one if right is left else [np.frombuffer(r, np.uint64) for r in right]]
    every = [np.concatenate(x) for x in sides]
    owner = [np.repeat(np.arange(len(n)), n) for n in sizes]
    if right is left:
        tokens, times = np.unique(every[0], return_counts=True)
        tokens = tokens[times > 1]
    else:
        tokens = np.intersect1d(np.unique(every[0]), np.unique(every[1]))
    both = np.zeros((len(left), len(right)), np.float64)
    if len(tokens):
        cols = []
        for side in range(1 if right is left else 2):
            at = np.minimum(np.searchsorted(tokens, every[side]), len(tokens) - 1)
            shared = np.flatnonzero(tokens[at] == every[side])
            shared = shared[np.argsort(at[shared], kind="stable")]
            cols.append((at[shared], owner[side][shared]))
        for c in range(0, len(tokens), 2048):
            m = []
            for (col, row), n in zip(cols, sizes, strict=False):
                a, b = np.searchsorted(col, [c, c + 2048])
                x = np.zeros((len(n), min(2048, len(tokens) - c)), np.float32)
                x[row[a:b], col[a:b] - c] = 1
                m.append(x)
            both += m[0] @ m[-1].T

    def test(i, j):
        union = sizes[0][i:j, None] + sizes[1][None, :] - both[i:j]
        return both[i:j] >= threshold * union - 1e-9

    return test


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9999, with_classes: bool = False) -> DataFrame:
    """One row per input row: id, class_id (smallest id reachable by links), n_links (other rows linked directly, copies included).

    Rows link if the Jaccard similarity of their n-word shingle sets is >= threshold. Words are runs of word characters in lower
    case; a text of fewer words is one shingle; null, empty and wordless texts link with nothing and are their own class. Rows of
    equal sets are one class, found by digest; only its representative is joined and counts as often as it occurs (repeated rows
    too). A null id links with nothing and has a null class. No rows give no rows; other columns are not read.
    With classes also k1, k2 (digest of the row's set) and component (the class itself: ids may repeat, so class_id may too).
    No cap applies: buckets past every split are salted, and candidate groups are checked in blocks."""
    n_runs = runs_needed(threshold, recall)
    rows = cut(sketch_texts(docs, n, n_runs, id_col, text_col), "sketches")
    usable = rows.where("k1 is not null and id is not null")
    grouped = usable.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("n_sh").alias("n_sh"), F.first("roots").alias("roots"), F.first("sketch").alias("sketch"))
    classes = cut(grouped.withColumn("cls", F.xxhash64("k1", "k2")), "classes")
    starts = classes.select(F.col("cls").alias("id"), "sketch", F.posexplode("roots").alias("run", "value")).select(F.xxhash64("run", "value").alias("key"), "id", "sketch")
    edges = bucket_links(starts, BYTES, LIMIT, _split, lambda level: _byte(_drawn(level, 0)), DEPTH)
    candidates = components(edges)
    members = cut(classes.join(candidates, F.col("cls") == F.col("id")).select(F.col("component").alias("grp"), "id", "rep", "k1", "weight", "n_sh"), "members")
    texts = docs.select(F.col(id_col).cast("bigint").alias("rep"), F.col(text_col).cast("string").alias("text"))
    sets = _sets_of(texts.join(members.hint("merge"), "rep").select("text", "k1", "grp", "id", "weight"), n)
    # A representative's id may come in several rows of its text: one of them stays.
    sets = cut(sets.groupBy("id").agg(F.first("grp").alias("grp"), F.first("weight").alias("weight"), F.first("shingles").alias("shingles")), "sets")
    drop(edges, candidates, members)
    blocks = block_pairs(sets, F.octet_length("shingles") / 8)
    drop(sets)
    found = cut(check_blocks(expand_pairs(blocks), "shingles", lambda left, right: jaccard_links(left, right, threshold)), "checked")
    drop(blocks)
    return results(rows, classes, found, id_col, with_classes).withColumnRenamed("component_id", "class_id")


def _digest(n: int = 5):
    """A text's k1 and k2 as sketch_texts has them."""

    @F.pandas_udf("k1 bigint, k2 bigint")
    def digest(texts: pd.Series) -> pd.DataFrame:
        shingle = Shingler(n)
        sets = [shingle(t or "") for t in texts]
        d = [xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else None for s in sets]
        return pd.DataFrame({"k1": pd.array([None if x is None else (x >> 64) - 2**63 for x in d], "Int64"), "k2": pd.array([None if x is None else (x & (2**64 - 1)) - 2**63 for x in d], "Int64")})

    return digest


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs, all columns: of each class of near copies the row with the smallest id (one of them if that id is repeated
    within the class). Rows with null ids and wordless rows stay.

    An id that occurs once tells its row; rows of a repeated id are told apart by the digest of their set, which is taken again
    for them alone."""
    joined = ngram_jaccard_join(docs, id_col, text_col, with_classes=True).where(F.col(id_col).isNotNull())
    joined = cut(joined.select(F.col(id_col).alias("__keep_id"), F.col("class_id").alias("__keep_class"), F.col("k1").alias("__keep_k1"), F.col("k2").alias("__keep_k2"), F.col("component").alias("__keep_component")), "joined")
    gone = cut(joined.where("__keep_id != __keep_class").select("__keep_id").distinct(), "gone")
    repeated = cut(joined.groupBy("__keep_id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__keep_id"), "repeated")
    own_id = F.col(id_col).cast("bigint") == F.col("__keep_id")
    if repeated.isEmpty():
        drop(joined, repeated)
        return docs.join(gone, own_id, "left_anti").select(docs.columns)
    first = F.min(F.struct("__keep_k1", "__keep_k2"))
    stays = joined.where("__keep_id = __keep_class and __keep_k1 is not null").join(repeated, "__keep_id", "left_semi").groupBy("__keep_id", "__keep_component").agg(first.alias("__keep_set"))
    stays = cut(stays.select("__keep_id", F.col("__keep_set.__keep_k1").alias("__keep_k1"), F.col("__keep_set.__keep_k2").alias("__keep_k2")), "stays")
    drop(joined)
    once = docs.join(repeated, own_id, "left_anti").join(gone, own_id, "left_anti").select(docs.columns)
    twice = docs.join(repeated, own_id, "left_semi").withColumn("__keep_digest", _digest()(F.col(text_col).cast("string")))
    twice = cut(twice, "twice")
    same = own_id & (F.col("__keep_digest.k1") == F.col("__keep_k1")) & (F.col("__keep_digest.k2") == F.col("__keep_k2"))
    one = twice.where("__keep_digest.k1 is not null").join(stays, same).dropDuplicates(["__keep_id", "__keep_k1", "__keep_k2"])
    return once.unionByName(twice.where("__keep_digest.k1 is null").select(docs.columns)).unionByName(one.select(docs.columns))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + least(5, len(w)) - 1], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.x, p.y FROM p JOIN n a ON p.x = a.doc_id JOIN n b ON p.y = b.doc_id WHERE p.c >= 0.8 * (a.n + b.n - p.c)),
reach AS (SELECT doc_id AS s, doc_id AS t FROM documents UNION SELECT r.s, l.y FROM reach r JOIN l ON r.t = l.x),
c AS (SELECT s AS doc_id, min(t) AS class_id FROM reach GROUP BY 1), m AS (SELECT x AS doc_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT c.doc_id, c.class_id, CAST(coalesce(m.n_links, 0) AS BIGINT) AS n_links FROM c LEFT JOIN m ON c.doc_id = m.doc_id
"""
