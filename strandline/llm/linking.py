"""Shared parts of the similarity joins: buckets -> candidate links -> candidate groups -> exact check in blocks -> components.

Buckets of any size are cut into groups of bounded size, one task at a time holds one. Only a spanning forest leaves a group,
never its pairs. Candidate groups are checked exactly in blocks, each pair of blocks in one task, so no task holds a whole group."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, kept


@dataclass(frozen=True)
class Sketch:
    """How many of `size` sketch bytes agree: at least `near` for a pair in question; rows that agree with a leader in `absorb`
    are left to it. By the triangle inequality of differing bytes, the leaders of a pair in question then agree as loose() says."""

    near: int
    absorb: int
    size: int = 64

    def loose(self, absorbed: int) -> int:
        """Least agreement of what stands for the two rows of a pair, each absorbed so often that it is `absorbed` in sum."""
        return self.near - absorbed * (self.size - self.absorb)

    @staticmethod
    def alike(one: np.ndarray, many: np.ndarray) -> np.ndarray:
        return (many == one).sum(1)


class Forest:
    """Union-find over positions; roots are the smallest positions."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of equal values in the first `keys` columns (64-bit integers) of rows that come sorted by them."""
    kept: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(b.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        for i, j in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(int(c[i]) for c in cols)
            if kept and key != last:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(b.slice(i, j - i))
            last = key
    if kept:
        yield pa.Table.from_batches(kept)


def _lead(sketches: np.ndarray, how: Sketch, loose: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Edges (as positions: from the first of each linked set to its others) and leaders of one group: each row is compared with
    the leaders so far by `loose`, and becomes one unless a leader is within how.absorb."""
    n = len(sketches)
    forest, leaders, held = Forest(n), [], np.empty((16, sketches.shape[1]), np.uint8)
    for i in range(n):
        near = how.alike(sketches[i], held[: len(leaders)]) if leaders else np.zeros(0, int)
        for k in np.flatnonzero(near >= loose).tolist():
            forest.join(leaders[k], i)
        if not len(near) or near.max() < how.absorb:
            if len(leaders) == len(held):
                held = np.concatenate([held, np.empty_like(held)])
            held[len(leaders)] = sketches[i]
            leaders.append(i)
    return [(r, i) for i in range(n) if (r := forest.find(i)) != i], leaders


def linked_sets(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges from the first of each linked set of positions 0..n-1 to its others; near(i, others) tells which of those link with i.
    What is reached is not compared again, so a set of copies costs its size, not its square."""
    edges, rest = [], np.arange(n)
    while len(rest) > 1:
        root, rest, front = int(rest[0]), rest[1:], [int(rest[0])]
        while front and len(rest):
            hit = near(front.pop(), rest)
            if hit.any():
                front += rest[hit].tolist()
                edges += [(root, j) for j in rest[hit].tolist()]
                rest = rest[~hit]
    return edges


_LINKS = "key bigint, a bigint, b bigint, sketch binary"


def _linked(rows: DataFrame, work: Callable[[list[bytes], bool], tuple[list[tuple[int, int]], list[int]]]) -> DataFrame:
    """rows: key, salt, salted, id, sketch. Edges (a, b) of each (key, salt) group by work(sketches, salted), and its leaders (b
    null, with their sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], []]

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["key", "a", "b", "sketch"])
            for c in out:
                c.clear()
            return made

        for t in groups(batches, 2):
            salted = t.column("salted")[0].as_py()
            if t.num_rows < 2 and not salted:
                continue
            ids, raw, key = t.column("id").to_numpy(), t.column("sketch").to_pylist(), t.column("key")[0].as_py()
            edges, leaders = work(raw, salted)
            for i, j in edges:
                if ids[i] != ids[j]:
                    for c, v in zip(out, (key, int(ids[i]), int(ids[j]), None), strict=True):
                        c.append(v)
            for i in leaders:
                for c, v in zip(out, (key, int(ids[i]), None, raw[i]), strict=True):
                    c.append(v)
            if len(out[0]) > 20_000:
                yield flush()
        if out[0]:
            yield flush()

    sorted_ = rows.select("key", "salt", "salted", "id", "sketch").repartition("key", "salt").sortWithinPartitions("key", "salt", "id")
    return sorted_.mapInArrow(run, _LINKS)


def bucket_links(rows: DataFrame, how: Sketch, limit: int = 64, split: Callable[[DataFrame, int], DataFrame] | None = None, sample: Callable[[int], Column] | None = None, depth: int = 5, stuck: float = 0.6) -> DataFrame:
    """Candidate links (a, b) of rows (key, id, sketch) that share a key.

    Keys are counted first (pre-aggregated); rows of lone keys go no further. Buckets over `limit` rows are split again by
    split(rows, level) up to `depth` levels, unless a share of `stuck` of their rows agrees on sample(level), the value a split
    would go by: near copies stay together however often they are split. What is still larger then, or stuck, is salted into groups
    of about `limit` rows, whose leaders are salted into groups once more; the leaders left are compared in pairs of blocks, so no
    task holds a key. The thresholds of the rounds see to it that a pair in question is linked whichever leaders stand for it."""
    parts, level, spent = [], 1, []
    while True:
        counts = cut(rows.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
        spent.append(counts)
        sized = rows.join(counts, F.col("key") == F.col("k")).select("key", "id", "sketch", "n")
        largest = counts.agg(F.max("n")).first()[0] or 0
        if split is None or level >= depth or largest <= limit:
            parts.append(sized)
            break
        sized = cut(sized, "sized")
        spent.append(sized)
        parts.append(sized.where(F.col("n") <= limit))
        level += 1
        big = sized.where(F.col("n") > limit)
        tops = big.groupBy("key", sample(level).alias("v")).agg(F.count(F.lit(1)).alias("c")).groupBy(F.col("key").alias("bucket")).agg(F.max("c").alias("top"))
        tops = cut(tops, "tops")
        big = cut(big.join(tops, F.col("key") == F.col("bucket")).select("key", "id", "sketch", "n", (F.col("top") >= F.col("n") * stuck).alias("stuck")), "big")
        drop(tops)
        spent.append(big)
        parts.append(big.where("stuck").drop("stuck"))
        rows = split(big.where("NOT stuck").drop("stuck"), level)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)

    def all_pairs(loose: int):
        def work(raw: list[bytes], salted: bool = False):
            sketches = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
            return linked_sets(len(raw), lambda i, rest: how.alike(sketches[i], sketches[rest]) >= loose), []

        return work

    def by_leaders(turn: int):
        # A row of the pair was absorbed `turn` times, as the other was, and one of them may be by a leader of this group.
        pairs, loose = all_pairs(how.near), how.loose(2 * turn + 1)
        return lambda raw, salted: _lead(np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1), how, loose) if salted else pairs(raw)

    found, turn = [], 0
    while True:
        # Powers of two, so that runs which hold much the same rows salt them alike and find the same links.
        salts = F.when(F.col("n") <= limit, F.lit(1)).otherwise(F.pow(F.lit(2), F.ceil(F.log2(F.col("n") / limit)))).cast("bigint")
        salted = every.withColumn("salted", (F.col("n") > limit) | F.lit(turn > 0)).withColumn("salt", F.pmod(F.xxhash64("id", F.lit(5 + turn)), salts))
        links = cut(_linked(salted, by_leaders(turn)), "links")
        found.append(links)
        drop(*spent)
        turn += 1
        leaders = links.where("b is null").select("key", F.col("a").alias("id"), "sketch")
        counts = cut(leaders.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "leaders")
        spent = [counts]
        largest = counts.agg(F.max("n")).first()[0] or 0
        every = leaders.join(counts, F.col("key") == F.col("k")).select("key", "id", "sketch", "n")
        if turn == 2 or largest <= BLOCK:
            if largest:
                found.append(cut(_linked(in_blocks(every), all_pairs(how.loose(2 * turn))), "links"))
            drop(*spent)
            break
    both = found[0].where("b is not null").select("a", "b")
    for f in found[1:]:
        both = both.unionByName(f.where("b is not null").select("a", "b"))
    out = cut(both.distinct(), "edges")
    drop(*found)
    return out


def bucket_pairs(rows: DataFrame, near: Callable[[list[bytes]], Callable[[np.ndarray, np.ndarray], np.ndarray]], strip: int = 256) -> DataFrame:
    """Links (a, b) of rows (key, id, sketch) that share a key, every pair of a bucket compared by near(sketches), which tells of
    some positions against others, as a matrix, whether they link; a spanning forest of each linked set leaves a task. Buckets
    over BLOCK rows are compared in pairs of blocks."""
    counts = cut(rows.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    sized = rows.join(counts, F.col("key") == F.col("k")).select("key", "id", "sketch", "n")

    def work(raw: list[bytes], salted: bool):
        test, every, met = near(raw), np.arange(len(raw)), np.zeros(len(raw), bool)
        for i in range(0, len(raw), strip):  # most rows of a bucket link with none: matrix products tell which do
            hit = test(every[i : i + strip], every)
            hit[np.arange(len(hit)), np.arange(i, i + len(hit))] = False
            met[i : i + strip] = hit.any(1)
        some = np.flatnonzero(met)
        return [(some[a], some[b]) for a, b in linked_sets(len(some), lambda i, rest: test(some[i : i + 1], some[rest])[0])], []

    links = cut(_linked(in_blocks(sized), work), "links")
    out = cut(links.select("a", "b").distinct(), "edges")
    drop(counts, links)
    return out


BLOCK = 1024


def in_blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (key, id, sketch, n) once for each pair of blocks they take part in, as salts: every pair of a key's rows meets in one
    group of about two blocks at most."""
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / block).cast("bigint")).withColumn("blk", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    salt = F.least("blk", "other") * F.col("blocks") + F.greatest("blk", "other")
    return rows.select("key", salt.alias("salt"), F.lit(False).alias("salted"), "id", "sketch")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in edges (a, b).

    Each round every id points to its least neighbour or itself (pre-aggregated), pointers are followed to their roots, and the
    edges are contracted to edges between roots, of which at most half as many are left. Tables are cut at each step; each join
    is of two plain exchanges, so a hub's rows are split by the adaptive skew join."""
    pair = lambda x, y: (F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi"))
    left = cut(edges.where("a != b").select(*pair("a", "b")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        both = left.select(F.col("lo").alias("id"), F.col("hi").alias("near")).unionByName(left.select(F.col("hi").alias("id"), F.col("lo").alias("near")))
        up = cut(both.groupBy("id").agg(F.min("near").alias("near")).select("id", F.least("id", "near").alias("up")), "up")
        while True:
            above = up.select(F.col("id").alias("up"), F.col("up").alias("top"))
            new = cut(up.join(above, "up").select("id", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "up")
            drop(up)
            up = new
            if up.where("moved").isEmpty():
                break
        rounds.append(kept(up.select("id", "up"), up))
        lo, hi = up.select(F.col("id").alias("lo"), F.col("up").alias("x")), up.select(F.col("id").alias("hi"), F.col("up").alias("y"))
        new = cut(left.join(lo, "lo").join(hi, "hi").where("x != y").select(*pair("x", "y")).distinct(), "edges")
        drop(left)
        left = new
    if not rounds:
        return kept(left.select(F.col("lo").alias("id"), F.col("hi").alias("component")), left)
    drop(left)
    out = rounds[0]
    for r in rounds[1:]:
        further = r.select(F.col("id").alias("up"), F.col("up").alias("top"))
        new = cut(out.join(further, "up", "left").select("id", F.coalesce("top", "up").alias("up")), "up")
        drop(out, r)
        out = new
    return kept(out.select("id", F.col("up").alias("component")), out)


def block_pairs(members: DataFrame, size: Column, block: int = 64, most: int = 32, largest: int = 4096, unit: int = 2_000_000) -> DataFrame:
    """members: grp, id, ... in; the same rows, as a table, with their group's number of blocks and their block (blocks, blk).

    A group of m rows has about m / block blocks, from `most` blocks on m / most rows each up to `largest` rows; never more than
    `unit` size units a block on average. Rows are counted by group first and joined by plain exchanges."""
    rows = members.withColumn("units", size.cast("bigint"))
    sums = cut(rows.groupBy(F.col("grp").alias("g")).agg(F.count(F.lit(1)).alias("m"), F.sum("units").alias("u")), "groups")
    n = F.greatest(F.ceil(F.col("m") / largest), F.least(F.lit(most), F.ceil(F.col("m") / block)), F.ceil(F.col("u") / unit))
    # Both sides grow with the data: the rows carry payloads, so the plan should not turn on the size of the other side.
    rows = rows.join(sums.hint("merge"), F.col("grp") == F.col("g")).drop("g").withColumn("blocks", n.cast("bigint")).withColumn("blk", F.pmod(F.xxhash64("id", F.lit(9)), F.col("blocks")))
    out = cut(rows, "blocks")
    drop(sums)
    return out


def expand_pairs(rows: DataFrame) -> DataFrame:
    """One copy of each row per pair of blocks: lo, hi and whether the row is of lo."""
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    return rows.withColumn("lo", F.least("blk", "other")).withColumn("hi", F.greatest("blk", "other")).drop("other")


def check_blocks(rows: DataFrame, payload: str, links: Callable[[list, list], Callable[[int, int], np.ndarray]], strip: int = 256) -> DataFrame:
    """rows: grp, lo, hi, blk, id, weight and the payload column. Exact links of every pair of rows of a group, each pair
    evaluated once: per row and task (id, links: summed weights of the linked, root: a linked id to join, or the id itself).

    links(left, right) prepares the payloads of the two blocks (one list twice for a block with itself); its result gives for
    rows [i, j) of the left a boolean matrix against all rows of the right, a strip at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, 3):
            lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
            ids, weight = t.column("id").to_numpy(), t.column("weight").to_numpy()
            raw, of_lo = t.column(payload).to_pylist(), t.column("blk").to_numpy() == lo
            left = np.flatnonzero(of_lo)
            right = left if lo == hi else np.flatnonzero(~of_lo)
            if not len(left) or not len(right):
                continue
            one = [raw[k] for k in left]
            test = links(one, one if lo == hi else [raw[k] for k in right])
            counts, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
            for i in range(0, len(left), strip):
                j = min(len(left), i + strip)
                hit = test(i, j)
                if lo == hi:
                    hit[np.arange(j - i), np.arange(i, j)] = False
                else:
                    counts[right] += weight[left[i:j]] @ hit
                counts[left[i:j]] += hit @ weight[right]
                for k in np.flatnonzero(hit.any(1)).tolist():
                    met, own = label[right[hit[k]]], label[left[i + k]]
                    if (met != own).any():
                        met = np.unique(np.append(met, own))
                        label[np.isin(label, met)] = met[0]
            some = np.flatnonzero(counts)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(counts[some]), pa.array(ids[label[some]])], ["id", "links", "root"])

    keyed = rows.select("grp", "lo", "hi", "blk", "id", "weight", payload).repartition("grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi", "id")
    return keyed.mapInArrow(run, "id bigint, links bigint, root bigint")
