"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network with
temperature-calibrated probabilities.

Words and shape marks (capitals, digits, sign runs, repeats) get sparse ternary index vectors from their hash. A word's vector
sums the index vectors of its neighbours in the training sample, of which the vectors are a part: they are fitted with the network
on the same bounded sample. Words not frequent there share one of BUCKETS rows by their hash. A document is the mean of its words'
vectors, their mean spread, and a few length-free ratios."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_mod, map_texts, table
from .toxicity import labelled

DIM, NONZERO, WINDOW = 96, 6, 2
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+|\n")
_CACHE, _LONG = 200_000, 64  # tokens kept, and the characters of the longest one that is


def index_vector(token: str) -> tuple[np.ndarray, np.ndarray]:
    """NONZERO places drawn from the token's hash, and their signs."""
    rng = np.random.default_rng(zlib.crc32(token.encode("utf-8", "replace")))
    return rng.permutation(DIM)[:NONZERO], rng.integers(0, 2, NONZERO) * 2 - 1


SHAPES = ["<word>", "<title>", "<caps>", "<digits>", "<sign>", "<signs>", "<line>"]


def shape(token: str) -> int:
    if token == "\n":
        return 6
    if token[0].isalpha():
        return 2 if len(token) > 1 and token.isupper() else 1 if token[0].isupper() else 0
    return 3 if token[0].isdigit() else 4 if len(token) == 1 else 5


class Vectors:
    """Token -> (row of word vectors, shape). Rows of unseen words are shared by hash, so the table stays bounded."""

    def __init__(self, vocabulary: dict[str, int], table_: np.ndarray) -> None:
        self.vocabulary, self.table = vocabulary, table_
        self.cache: dict[str, int] = {}

    def rows(self, text: str) -> np.ndarray:
        """Row * 8 + shape of each token."""
        cache, out = self.cache, []
        tokens = _TOKEN.findall(text)
        try:
            out = [cache[t] for t in tokens]
        except KeyError:
            if len(cache) > _CACHE:
                cache.clear()
            for t in tokens:
                k = cache.get(t)
                if k is None:
                    low = t.lower()
                    row = self.vocabulary.get(low)
                    if row is None:
                        row = len(self.vocabulary) + zlib.crc32(low.encode("utf-8", "replace")) % BUCKETS
                    k = row * 8 + shape(t)
                    if len(t) <= _LONG:
                        cache[t] = k
                out.append(k)
        return np.array(out, np.int64)

    def pooled(self, text: str) -> np.ndarray:
        rows, parts, n = self.rows(text), [], 0
        if not len(rows):
            return np.zeros(2 * DIM + len(SHAPES) + 4, np.float32)
        total, square = np.zeros(DIM), np.zeros(DIM)
        for i in range(0, len(rows), 1 << 16):  # long texts are pooled in blocks
            v = self.table[rows[i : i + (1 << 16)] >> 3]
            total += v.sum(0)
            square += np.einsum("ij,ij->j", v, v)
        n = len(rows)
        mean = total / n
        parts = [mean, np.sqrt(np.maximum(square / n - mean**2, 0))]
        words = rows >> 3
        ratios = [len(np.unique(words)) / n, float((words[1:] == words[:-1]).mean()) if n > 1 else 0.0, np.log1p(n) / 10, len(text) / n / 10]
        return np.concatenate([*parts, np.bincount(rows & 7, minlength=8)[: len(SHAPES)] / n, ratios]).astype(np.float32)


BUCKETS = 4096


def random_indexing(texts: list[str], least: int = 3) -> Vectors:
    """Word vectors from the neighbours within WINDOW words, for words in at least `least` places of the sample."""
    from collections import Counter

    tokens = [[t.lower() for t in _TOKEN.findall(x)] for x in texts]
    counts = Counter(t for x in tokens for t in x)
    vocabulary = {t: i for i, t in enumerate(sorted(t for t, k in counts.items() if k >= least))}
    n = len(vocabulary)
    size = n + BUCKETS
    drawn = [index_vector(t) for t in [*vocabulary, *(f"<{b}>" for b in range(BUCKETS))]]
    place, sign = np.stack([p for p, _ in drawn]), np.stack([x for _, x in drawn]).astype(np.float64)
    flat = np.zeros(size * DIM)
    flat[(np.arange(size)[:, None] * DIM + place).ravel()] = sign.ravel()
    pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def add() -> None:
        """Add the neighbours' index vectors to each word's, entry by entry: they are sparse."""
        word, near = (np.concatenate(x) for x in zip(*pairs, strict=True))
        flat[:] += np.bincount((word[:, None] * DIM + place[near]).ravel(), sign[near].ravel(), size * DIM)
        pairs.clear()

    for x in tokens:
        rows = np.array([vocabulary[t] if t in vocabulary else n + zlib.crc32(t.encode("utf-8", "replace")) % BUCKETS for t in x], np.int64)
        for d in range(1, WINDOW + 1):
            if len(rows) > d:
                pairs += [(rows[d:], rows[:-d]), (rows[:-d], rows[d:])]
        if sum(len(w) for w, _ in pairs) > 1_000_000:
            add()
    if pairs:
        add()
    vectors = flat.reshape(size, DIM).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-6
    return Vectors(vocabulary, vectors)


@dataclass
class QualityModel:
    vectors: Vectors | None
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]  # w1, b1, w2, b2
    temperature: float
    bias: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, texts: list[str]) -> np.ndarray:
        if self.vectors is None:
            return np.full(len(texts), self.prior)
        x = np.stack([self.vectors.pooled(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip((self.logits(x) + self.bias) / self.temperature, -30, 30)))


def fit(texts: list[str], labels: list[int], hidden: int = 24, epochs: int = 60, decay: float = 1e-3, seed: int = 3) -> QualityModel:
    """Adam on four fifths of the sample; the epoch, temperature and bias come from the other fifth."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return QualityModel(None, np.zeros(0), np.ones(0), [], 1.0, 0.0, float(y.mean()) if len(y) else 0.5)
    vectors = random_indexing(texts)
    x = np.stack([vectors.pooled(t) for t in texts]).astype(np.float64)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    cut = max(1, len(y) // 5)
    held, own = order[:cut], order[cut:]
    mean, scale = x[own].mean(0), x[own].std(0) + 1e-3
    model = QualityModel(vectors, mean, scale, [rng.normal(0, 0.1, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), np.zeros(1)], 1.0, 0.0, float(y.mean()))
    m, v = [np.zeros_like(p) for p in model.layers], [np.zeros_like(p) for p in model.layers]
    best, best_loss, t = [p.copy() for p in model.layers], np.inf, 0
    loss = lambda z, a, b: float(np.mean(np.logaddexp(0, -(2 * y[held] - 1) * (z + b) / a)))
    xs = (x - mean) / scale
    for _ in range(epochs):
        rng.shuffle(own)
        for i in range(0, len(own), 64):
            k = own[i : i + 64]
            h = np.tanh(xs[k] @ model.layers[0] + model.layers[1])
            g = (1 / (1 + np.exp(-(h @ model.layers[2] + model.layers[3]))) - y[k]) / len(k)
            back = np.outer(g, model.layers[2]) * (1 - h**2)
            grads = [xs[k].T @ back + decay * model.layers[0], back.sum(0), h.T @ g + decay * model.layers[2], g.sum(keepdims=True)]
            t += 1
            for j, grad in enumerate(grads):
                m[j], v[j] = 0.9 * m[j] + 0.1 * grad, 0.999 * v[j] + 0.001 * grad**2
                model.layers[j] -= 0.003 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
        now = loss(model.logits(x[held]), 1.0, 0.0)
        if now < best_loss:
            best, best_loss = [p.copy() for p in model.layers], now
    model.layers = best
    z = model.logits(x[held])
    model.temperature, model.bias = min(((a, b) for a in np.geomspace(0.3, 5, 25) for b in np.linspace(-2, 2, 21)), key=lambda p: loss(z, *p) + 1e-4 * p[1] ** 2)
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = 3000, max_chars: int = 20_000) -> QualityModel:
    """Fit on a bounded sample: about `rows` labelled rows of either class (see toxicity.labelled), id crc32 mod 5 not 0. As both
    classes are sampled alike where both are plentiful, the bias is moved back by the classes' full counts."""
    pick = lambda c: id_mod(c, 5) != 0
    got = labelled(docs, labels, "quality", pick, rows, max_chars)
    model = fit([t for t, _ in got], [y for _, y in got])
    full = {r["quality"]: r["n"] for r in labels.where(pick("doc_id") & F.col("quality").isin(0, 1)).groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if model.vectors is not None and full.get(0) and full.get(1):
        ours = sum(y for _, y in got)
        model.bias += model.temperature * (np.log(full[1] / full[0]) - np.log(ours / (len(got) - ours)))
    return model


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score (probability of label 1). Null and empty texts are scored as documents of no words;
    without labels of both classes every row gets the label mean (0.5 without labels). Repeated rows each get a row; no rows
    give no rows; other columns are not read. The model is broadcast (bounded by its sample); no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        return lambda _, texts: {"score": pa.array(own.score(texts), pa.float64())}

    return map_texts(docs, id_col, text_col, "score double", make)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(id_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
