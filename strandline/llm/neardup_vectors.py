"""Embedding near-dedup: Euclidean p-stable hashing of normalised vectors in several tables, then exact cosine checks.

Table t hashes a unit vector v to the quantised projections floor((a_i . v + b_i) / width), i = 1..k. Two unit vectors of cosine
c lie at distance sqrt(2 - 2c), which fixes how often they share a table; the number of tables follows from the target recall.
Rows that share a bucket are compared by their vectors in 8-bit steps, which is off by little, so what is linked there is linked
in truth or nearly so and groups do not grow by chance; those groups are then checked, and counted, by exact cosines."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, table
from .linking import block_pairs, bucket_pairs, check_blocks, components, expand_pairs

BUCKET = 256  # unrelated vectors (at a right angle) that a bucket holds on the average: comparing them costs less than more tables
DIMS = 128  # longer vectors are compared in so many projected dimensions


def share_of_projection(distance: float, width: float) -> float:
    """P(two points at that distance fall into one quantisation cell of a Gaussian projection)."""
    r = width / distance
    phi = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables_needed(cosine: float, k: int, width: float, recall: float) -> int:
    p = share_of_projection(math.sqrt(max(2 - 2 * cosine, 1e-12)), width) ** k
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def _unit(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of a column of vectors, the positions of its usable ones and their unit vectors in double precision."""
    sizes = np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components are NaN here
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        x = flat[starts[at][:, None] + np.arange(d)]
        fine = np.isfinite(x).all(1) & x.any(1)
        at, x = at[fine], x[fine]
        most = np.abs(x).max(1, initial=0)
        with np.errstate(over="ignore"):
            norm = np.sqrt(np.square(x / most[:, None]).sum(1)) * most
        fine = (norm > 0) & np.isfinite(norm)
        yield at[fine], x[fine] / norm[fine, None]


def steps(x: np.ndarray, project: np.ndarray | None) -> np.ndarray:
    """Unit vectors, projected if they are long, in steps of a 127th of their largest component."""
    y = x if project is None else x @ project
    return np.rint(y * (127 / np.abs(y).max(1, keepdims=True))).astype(np.int8)


def screen(cosine: float, dims: int) -> float:
    """Least cosine that two vectors of `cosine` may have after steps(): rounding turns each by an angle of sin sqrt(dims) / 254 at
    most; a projection has a deviation of (1 - c * c) / sqrt(DIMS) besides, of which six are allowed."""
    turned = math.asin(min(1.0, math.sqrt(min(dims, DIMS)) / 254))
    low = cosine if dims <= DIMS else cosine - 6 * (1 - cosine * cosine) / math.sqrt(DIMS)
    return math.cos(min(math.pi, math.acos(max(-1.0, low)) + 2 * turned))


def projection(dims: int) -> np.ndarray | None:
    return np.random.default_rng(dims + 7).normal(size=(dims, DIMS)) / math.sqrt(DIMS) if dims > DIMS else None


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, k: int | None = None, width: float = 2.0, recall: float = 0.999) -> DataFrame:
    """One row per input row: id, n_links (other vectors of cosine >= `cosine`), component_id (smallest id reachable), kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different
    lengths with each other. Equal vectors (also under one id in repeated rows) are classes; only representatives are hashed,
    and each counts as often as it occurs. Repeated ids with different vectors are different vectors that share a component id
    range. A null id links with nothing and gets a null component. No rows give no rows.
    k defaults to what leaves about BUCKET unrelated vectors in a bucket, given the row count; `recall` is that of a pair at the
    threshold to share a table, and sets the number of tables, which grows with the logarithm of the rows."""
    if k is None:
        k = max(4, round(math.log(max(vectors.count(), 2) / BUCKET) / -math.log(share_of_projection(math.sqrt(2), width))))
    n_tables = tables_needed(cosine, k, width, recall)

    def sign(batches):
        import xxhash

        drawn: dict[int, tuple] = {}
        mix = np.random.default_rng(29).integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for b in batches:
            key1, key2, ok = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, bool)
            tables: list = [None] * b.num_rows
            short: list = [None] * b.num_rows
            units: list = [None] * b.num_rows
            for at, rows in _unit(b.column(1)):
                d = rows.shape[1]
                if d not in drawn:
                    rng = np.random.default_rng(d)
                    drawn[d] = rng.normal(size=(d, n_tables * k)), rng.uniform(0, width, n_tables * k), projection(d)
                a, shift, project = drawn[d]
                ok[at] = True
                for i in range(0, len(at), 512):
                    x = rows[i : i + 512]
                    cells = np.floor((x @ a + shift) / width).astype(np.int64).reshape(len(x), n_tables, k)
                    with np.errstate(over="ignore"):  # the keys of buckets: a multilinear hash of the k cells
                        keys = (cells.view(np.uint64) * mix).sum(2) + np.uint64(d)
                    stepped = steps(x, project)
                    for r, g in enumerate(at[i : i + 512].tolist()):
                        units[g] = x[r].tobytes()
                        key1[g], key2[g] = xxhash.xxh64_intdigest(units[g], 1) - 2**63, xxhash.xxh64_intdigest(units[g], 2) - 2**63
                        tables[g] = keys[r].view(np.int64)
                        short[g] = d.to_bytes(4, "little") + stepped[r].tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key1, mask=~ok), pa.array(key2, mask=~ok), pa.array(tables, pa.list_(pa.int64())), pa.array(short, pa.binary()), pa.array(units, pa.binary())], ["id", "k1", "k2", "tables", "short", "unit"])

    def near(raw: list[bytes]):
        """Which of a bucket's rows may link: those of a length whose stepped vectors reach the screened cosine."""
        size = max(map(len, raw))
        every = np.frombuffer(b"".join(r.ljust(size, b"\0") for r in raw), np.int8).reshape(len(raw), -1)
        dims = np.ascontiguousarray(every[:, :4]).view("<i4")[:, 0]
        x = every[:, 4:].astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        of = {d: screen(cosine, d) - 1e-4 for d in set(dims.tolist())}
        least = np.array([of[d] for d in dims.tolist()], np.float32)[:, None]
        if len(of) == 1:
            return lambda some, others: x[some] @ x[others].T >= least[some]
        return lambda some, others: (x[some] @ x[others].T >= least[some]) & (dims[some][:, None] == dims[others])

    def links(left: list[bytes], right: list[bytes]):
        """Exact cosines of the left's rows with the right's; vectors of different lengths do not link."""
        size = max(map(len, [*left, *right]))
        x, y = (np.stack([np.frombuffer(r.ljust(size, b"\0"), np.float64) for r in side]) for side in (left, right))
        p, q = (np.array([len(r) for r in side]) for side in (left, right))
        return lambda i, j: ((x[i:j] @ y.T) >= cosine) & (p[i:j, None] == q[None, :])

    plain = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    signed = cut(plain.mapInArrow(sign, "id bigint, k1 bigint, k2 bigint, tables array<bigint>, short binary, unit binary"), "vectors")
    usable = signed.where("k1 is not null and id is not null")
    grouped = usable.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("tables").alias("tables"), F.first("short").alias("short"), F.first("unit").alias("unit"))
    classes = cut(grouped.withColumn("cls", F.xxhash64("k1", "k2")), "classes")
    rows = classes.select(F.col("cls").alias("id"), F.col("short").alias("sketch"), F.posexplode("tables").alias("t", "value")).select(F.xxhash64("t", "value").alias("key"), "id", "sketch")
    edges = bucket_pairs(rows, near)
    candidates = components(edges)
    members = cut(classes.join(candidates, F.col("cls") == F.col("id")).select(F.col("component").alias("grp"), "id", "weight", "unit"), "members")
    blocks = block_pairs(members, F.octet_length("unit") / 8, largest=2048)
    drop(edges, candidates, members)
    found = cut(check_blocks(expand_pairs(blocks), "unit", links), "checked")
    drop(blocks)
    return results(signed, classes, found, id_col)


def results(rows: DataFrame, classes: DataFrame, found: DataFrame, id_col: str, with_classes: bool = False) -> DataFrame:
    """Counts and components of classes carried to all rows (id, k1, k2); drops the tables of classes and found. With classes
    also k1, k2 and `component`, which tells components of equal smallest ids apart (null for rows that are in none)."""
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    comp = joined.withColumnRenamed("id", "c")
    per = classes.select("k1", "k2", "cls", "rep", "weight").join(counts, F.col("cls") == counts["id"], "left").drop("id").join(comp, F.col("cls") == F.col("c"), "left").drop("c")
    per = cut(per.withColumn("component", F.coalesce("component", "cls")), "classes")
    least = cut(per.groupBy(F.col("component").alias("g")).agg(F.min("rep").alias("component_id")), "least")
    drop(classes, found, joined)
    n_links = (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    done = cut(per.join(least, F.col("component") == F.col("g")).select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), n_links, "component_id", "component"), "results")
    drop(per, least)
    more = ["k1", "k2", "component"] if with_classes else []
    out = rows.select("id", "k1", "k2").join(done, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & F.col("id").isNotNull(), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), *more)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS s, vec_id AS t FROM v UNION SELECT r.s, p.y FROM reach r JOIN pairs p ON r.t = p.x),
c AS (SELECT s AS vec_id, min(t) AS component_id FROM reach GROUP BY 1), n AS (SELECT x AS vec_id, count(*) AS n_links FROM pairs GROUP BY 1)
SELECT c.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n ON c.vec_id = n.vec_id
"""
