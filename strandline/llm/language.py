"""Language ID: blended-spectrum n-gram presence kernels, Nystroem landmarks, one-versus-rest kernel ridge regression.

k(x, y) = |X & Y| / sqrt(|X| |Y|) over the sets X, Y of hashed character n-grams, n = 1..3. Scoring is two batched matrix
products: presence rows times landmark columns, then kernel rows times the regression's weights. A text scored under SURE is
scored again as the mean over windows of WINDOW characters. Whether a text is of a learned language at all is told by the share
of its n-grams that the training texts of its two best languages hold, which does not turn on how many languages there are."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import class_sample, id_mod, map_texts, slices, table

BITS = 17
SURE, WINDOW = 0.97, 300
LEAST, SPREAD = 0.65, 0.5  # least share of known n-grams, less SPREAD / sqrt(their number) for short texts
_LETTER = regex.compile(r"\p{L}")
_PIECE = 1 << 20  # characters looked at together; their n-gram sets are united
_MULT = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def presence(text: str) -> np.ndarray:
    """Set of hashed n-grams of the lower-cased text, n = 1..3, as 2**BITS booleans."""
    seen = np.zeros(1 << BITS, bool)
    shift = np.uint32(32 - BITS)
    for i in range(0, len(text), _PIECE):
        c = np.frombuffer(text[max(0, i - 2) : i + _PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        with np.errstate(over="ignore"):
            h = (c + np.uint32(1)) * _MULT[0]
            seen[(h ^ (h >> np.uint32(15))) * _MULT[1] >> shift] = True
            for n in (1, 2):
                if len(c) <= n:
                    break
                h = (h[:-1] ^ (h[:-1] >> np.uint32(13))) * _MULT[n] + (c[n:] + np.uint32(1)) * _MULT[0]
                seen[(h ^ (h >> np.uint32(15))) * _MULT[1] >> shift] = True
    return seen


@dataclass
class LanguageModel:
    languages: list[str]
    columns: np.ndarray  # n-gram buckets that any landmark has
    landmarks: np.ndarray  # columns x landmarks, each 1 / sqrt(|L|) or 0
    weights: np.ndarray  # landmarks x languages
    known: np.ndarray  # languages x 2**BITS / 8: the n-gram buckets of each language's training texts, as bits

    def margins(self, texts: list[str], packed: list | None = None) -> np.ndarray:
        """Margins of each language; with `packed` also the texts' n-gram buckets as bits, appended to it."""
        rows, sizes = np.empty((len(texts), len(self.columns)), np.float32), np.empty(len(texts))
        for i, t in enumerate(texts):
            seen = presence(t)
            rows[i], sizes[i] = seen[self.columns], np.count_nonzero(seen)
            if packed is not None:
                packed.append(np.packbits(seen))
        kernel = (rows @ self.landmarks) / np.sqrt(np.maximum(sizes, 1))[:, None]
        return kernel @ self.weights

    def recognise(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language of each text, and whether it is of a learned language: the share of its n-grams that the training texts of
        its two best languages hold reaches LEAST, less SPREAD over the root of their number, as a short text says little."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts), bool)
        packed: list[np.ndarray] = []
        margins = self.margins(texts, packed)
        best = np.argsort(-margins, 1, kind="stable")[:, :2]
        ok = np.zeros(len(texts), bool)
        for i, (bits, pair) in enumerate(zip(packed, best, strict=True)):
            size = int(np.bitwise_count(bits).sum())
            held = int(np.bitwise_count(bits & np.bitwise_or.reduce(self.known[pair], 0)).sum())
            ok[i] = bool(_LETTER.search(texts[i])) and held / max(size, 1) >= LEAST - SPREAD / np.sqrt(max(size, 1))
        return self.predict(texts, margins)[0], ok

    def predict(self, texts: list[str], margins: np.ndarray | None = None) -> tuple[list[str], np.ndarray]:
        """Language and a score from 0 to 1: the softmax share of the best margin; 'und' with 0 without a letter or a model."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        m = (self.margins(texts) if margins is None else margins) * 4
        e = np.exp(m - m.max(1, keepdims=True))
        for i in np.flatnonzero(1 / e.sum(1) < SURE):  # texts of several languages: the mean over windows weighs them by length
            windows = [texts[i][k : k + WINDOW] for k in range(0, len(texts[i]), WINDOW)]
            if len(windows) > 1:
                m[i] = sum(self.margins(windows[k : k + 64]).sum(0) for k in range(0, len(windows), 64)) * 4 / len(windows)
                e[i] = np.exp(m[i] - m[i].max())
        best, lettered = m.argmax(1), np.array([bool(_LETTER.search(t)) for t in texts], bool)
        return [self.languages[b] if x else "und" for b, x in zip(best, lettered, strict=True)], np.where(lettered, 1 / e.sum(1), 0.0)


def fit(texts: list[str], languages: list[str], n_landmarks: int = 48, ridge: float = 1e-2) -> LanguageModel:
    """n_landmarks per language are the first rows of each; all rows are regressed on."""
    known = sorted(set(languages))
    if not known:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0)), np.zeros((0, 0), np.uint8))
    sets = [presence(t) for t in texts]
    y = np.array([known.index(x) for x in languages])
    chosen = np.concatenate([np.flatnonzero(y == k)[:n_landmarks] for k in range(len(known))])
    columns = np.flatnonzero(np.any([sets[i] for i in chosen], axis=0))
    size = np.sqrt([max(1, np.count_nonzero(s)) for s in sets])
    x = np.array([s[columns] for s in sets], np.float32) / size[:, None].astype(np.float32)
    land = x[chosen]
    values, vectors = np.linalg.eigh((land @ land.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # Nystroem features are k(x, landmarks) @ root
    phi = (x @ land.T).astype(np.float64) @ root
    share = 1 / np.sqrt(np.bincount(y, minlength=len(known)))[y]  # classes weigh alike up to a square root
    target = np.where(y[:, None] == np.arange(len(known)), 1.0, -1.0)
    a = phi * share[:, None]
    w = np.linalg.solve(a.T @ phi + ridge * np.eye(phi.shape[1]), a.T @ target)
    held = np.stack([np.packbits(np.logical_or.reduce([sets[i] for i in np.flatnonzero(y == k)])) for k in range(len(known))])
    return LanguageModel(known, columns, np.ascontiguousarray(land.T), root @ w, held)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_class: int = 300, max_chars: int = 20_000) -> LanguageModel:
    """Fit on a bounded sample: about per_class rows of each language by a hash of the id, with texts of 1 to max_chars
    characters, id crc32 mod 4 other than 2 and a language. Without such rows the model predicts 'und'."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where("lang is not null and text is not null").where(F.coalesce(id_mod("id", 4) != 2, F.lit(True)))
    kept, _, bound = class_sample(rows, "lang", ["id"], per_class)
    got = kept.where(F.length("text").between(1, max_chars)).limit(bound).collect() if bound else []
    got = sorted({(r["lang"], r["text"]) for r in got if _LETTER.search(r["text"])}, key=lambda r: (r[0], hash_text(r[1])))
    return fit([t for _, t in got], [x for x, _ in got])


def hash_text(t: str) -> int:
    import zlib

    return zlib.crc32(t.encode("utf-8", "replace"))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score. Null or letterless texts give 'und' and 0; repeated rows each get a row;
    no rows give no rows; other columns are not read. The model (bounded by its sample) is broadcast; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def f(_, texts):
            lang, score = own.predict(texts)
            return {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())}

        return f

    return map_texts(docs, id_col, text_col, "lang_pred string, score double", make, rows=64)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, train(docs))
    return out.select("doc_id", F.coalesce(id_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows of docs, all columns, whose text is of a learned language (see recognise); one pass, no join. A null language becomes
    the predicted one. Null, empty and letterless texts go; without a model every row goes; repeated rows are judged alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(lang_col) if lang_col in docs.columns else None

    def run(batches):
        own = shared.value
        for b in slices(batches, 64):
            lang, ok = own.recognise([t or "" for t in b.column(text_col).to_pylist()])
            if at is not None and b.column(at).null_count:
                filled = pa.compute.coalesce(b.column(at), pa.array(lang, pa.string()).cast(b.column(at).type))
                b = b.set_column(at, b.schema.field(at), filled)
            yield b.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)


def filter_texts(docs: DataFrame, text_col: str, make) -> DataFrame:
    """Rows of docs, all columns as they are, for whose text make()(texts) is true; a map over the scan."""

    def run(batches):
        f = make()
        for b in slices(batches, 64):
            texts = [t or "" for t in b.column(text_col).to_pylist()]
            yield b.filter(pa.array(np.asarray(f(texts), bool)))

    return docs.mapInArrow(run, docs.schema)
