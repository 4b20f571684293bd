"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding homoglyphs and digit substitutions, normalised by length,
with exception phrases."""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import class_sample, id_mod, map_texts, table

# Look-alike letters of other scripts, and digits and signs used for letters.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}

_ZERO = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_FOLD = str.maketrans({k: v for k, v in HOMOGLYPHS.items()} | DIGITS | {chr(k): None for k in _ZERO})
_SIGN = re.compile(r"(?<=\w)[@$!|+](?=\w)|(?<!\S)[@$](?=\w)")
_ODD = re.compile(r"[0-9\xadıɐ-\U0010ffff]")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case, compatibility forms, no accents on look-alikes' base letters added: homoglyphs, digits and signs become letters."""
    if _ODD.search(text):
        if not text.isascii():
            text = unicodedata.normalize("NFKC", text)
        text = text.lower().translate(_FOLD)
    else:
        text = text.lower()
    return _SIGN.sub(lambda m: SIGNS[m[0]], text)


def outside(found: list[tuple[int, int, float]], spans: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
    """What lies in no span: of the spans that begin no later, none ends as late. Sorted once, so texts with many of both cost
    little more than their length."""
    spans = sorted(spans)
    begins, reach = [b for b, _ in spans], list(accumulate((e for _, e in spans), max))
    return [x for x in found if not (k := bisect_right(begins, x[0])) or reach[k - 1] < x[1]]


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]  # word beginnings, or whole words marked by a final NUL, and their weights
    exceptions: list[str] = field(default_factory=list)  # phrases in which a lexicon entry does not count
    coef: tuple[float, float, float] = (-4.0, 2.0, 1.0)

    def matcher(self):
        a = ahocorasick.Automaton()
        for w, weight in self.lexicon.items():
            a.add_word(w.rstrip("\0"), (len(w.rstrip("\0")), weight, w[-1] == "\0"))
        spans = ahocorasick.Automaton()
        for w in self.exceptions:
            spans.add_word(w, (len(w), 0.0, True))
        for x in (a, spans):
            if len(x):
                x.make_automaton()

        def hits(folded: str, automaton) -> list[tuple[int, int, float]]:
            out = []
            if len(automaton):
                for end, (n, weight, whole) in automaton.iter(folded):
                    begin = end - n + 1
                    if (not begin or not folded[begin - 1].isalnum()) and not (whole and end + 1 < len(folded) and folded[end + 1].isalnum()):
                        out.append((begin, end + 1, weight))
            return out

        def match(text: str) -> tuple[float, int, list[tuple[int, int, float]]]:
            """Weight sum, number of words and spans of the longest match at each word, in the folded text."""
            folded = fold(text)
            longest = {}
            for b, e, w in hits(folded, a):
                if b not in longest or e > longest[b][1]:
                    longest[b] = (b, e, w)
            found = list(longest.values())
            if found and self.exceptions:
                found = outside(found, [(b, e) for b, e, _ in hits(folded, spans)])
            return sum(w for _, _, w in found), len(_WORD.findall(folded)), found

        return match

    def score(self, weight, words):
        """Probability from the weight sum and its density per thousand words; both count only upwards."""
        c0, c1, c2 = self.coef
        z = c0 + c1 * np.log1p(weight) + c2 * np.log1p(1000 * np.asarray(weight) / (np.asarray(words) + 50.0))
        return 1 / (1 + np.exp(-z))


def _g2(p: int, n: int, n1: int, n0: int) -> float:
    """Log-likelihood ratio of a term's document counts in two classes."""
    t, total = 0.0, p + n
    for k, m in ((p, n1), (n, n0)):
        if k:
            t += 2 * k * math.log(k * (n1 + n0) / (total * m))
    return t


def first_of_copies(texts: list[str], hashes: int = 4) -> list[int]:
    """Places of texts that share fewer than three of four min-hashes over three-word shingles with earlier ones: copies are not
    independent evidence for a word."""
    import xxhash

    seen: set = set()
    out = []
    for i, t in enumerate(texts):
        w = t.split()
        shingles = {" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))}
        h = np.array([xxhash.xxh64_intdigest(x) for x in shingles], np.uint64)
        with np.errstate(over="ignore"):
            key = {(k, int(((h ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)).min())) for k in range(1, hashes + 1)}
        if len(key & seen) < 3:
            out.append(i)
        seen |= key
    return out


def fit(texts: list[str], toxic: list[int], least_g2: float = 24.0, least_ratio: float = 8.0, longest: int = 14) -> ToxicityModel:
    """Lexicon entries are whole words of up to `longest` letters and beginnings, of 4 letters at least, of longer words, whose
    share of toxic documents is least_ratio times that of clean ones, at a log-likelihood ratio of least_g2, near copies counted
    once; each beginning grows to the longest one that keeps 95 % of its documents.
    Exceptions are whole words that begin like an entry but are no sign of toxicity, and two-word phrases around entries that
    recur in clean documents and hardly in toxic ones."""
    fresh = first_of_copies(texts)
    texts, toxic = [texts[i] for i in fresh], [toxic[i] for i in fresh]
    words = [set(_WORD.findall(fold(t))) for t in texts]
    n1, n0 = sum(toxic), len(toxic) - sum(toxic)
    if not n1 or not n0:
        return ToxicityModel({})

    def beginnings(ws, only=None):
        """Beginnings of longer words, and whole words marked by a final NUL."""
        found = {w[:k] for w in ws for k in range(4, min(len(w), longest + 1))} | {w + "\0" for w in ws if len(w) <= longest}
        return found if only is None else found & only.keys()

    p: Counter = Counter()
    for w, y in zip(words, toxic, strict=True):
        if y:
            p.update(beginnings(w))
    p = Counter({k: v for k, v in p.items() if v >= 4})
    n: Counter = Counter()
    for w, y in zip(words, toxic, strict=True):
        if not y:
            n.update(beginnings(w, p))
    ratio = lambda k: ((p[k] + 0.5) / (n1 + 1)) / ((n[k] + 0.5) / (n0 + 1))
    good = {k for k in p if ratio(k) >= least_ratio and _g2(p[k], n[k], n1, n0) >= least_g2}
    children: dict[str, list[str]] = {}
    for k in p:
        children.setdefault(k[:-2] if k[-1] == "\0" else k[:-1], []).append(k)
    lexicon: dict[str, float] = {}
    for k in sorted(good, key=lambda k: (len(k), k)):
        if any(k[:i] in good for i in range(4, len(k.rstrip("\0")))) or k[-1] == "\0" and k[:-1] in good:
            continue
        while nxt := [c for c in children.get(k, []) if p[c] >= 0.95 * p[k]]:
            k = nxt[0]
        weight = math.log(ratio(k))
        if k[-1] == "\0" and len(k) > 4 and n[k[:-1]] < 3:
            k = k[:-1]  # nothing speaks against its longer forms
        lexicon[k] = weight
    spared = sorted({w[:-1] for w in n if w[-1] == "\0" and w not in lexicon and n[w] >= 3 and ratio(w) < 3 and any(w[:i] in lexicon for i in range(4, len(w)))})
    model = ToxicityModel(lexicon, spared)
    match = model.matcher()
    seen = {0: Counter(), 1: Counter()}
    for t, y in zip(texts, toxic, strict=True):
        phrases = set()
        folded = fold(t)
        for b, e, _ in match(t)[2]:
            m = _WORD.match(folded, b)
            end = m.end() if m else e
            after = _WORD.search(folded, end)
            before = re.search(r"\w+\W+$", folded[max(0, b - 40) : b])
            phrases |= {folded[b:end]} | ({folded[b : after.end()]} if after else set()) | ({before[0] + folded[b:end]} if before else set())
        seen[int(y)].update(phrases)
    model.exceptions = sorted(set(spared)).copy() + sorted(x for x, k in seen[0].items() if k >= 3 and (k / n0) > 20 * (seen[1][x] + 0.5) / n1)
    match = model.matcher()
    got = [match(t)[:2] for t in texts]
    s, m, y = np.array([g[0] for g in got]), np.array([g[1] for g in got], float), np.array(toxic, float)
    x = np.stack([np.ones(len(s)), np.log1p(s), np.log1p(1000 * s / (m + 50))], 1)
    w = np.array([-3.0, 1.0, 0.5])
    for _ in range(50):  # ridge logistic regression, slopes kept from falling below zero
        q = 1 / (1 + np.exp(-x @ w))
        h = (x * (q * (1 - q) + 1e-6)[:, None]).T @ x + 0.5 * np.eye(3)
        w = w - np.linalg.solve(h, x.T @ (q - y) + 0.5 * np.array([0, w[1], w[2]]))
        w[1:] = np.maximum(w[1:], 0.05)
    model.coef = tuple(map(float, w))
    return model


def labelled(docs: DataFrame, labels: DataFrame, label: str, train_rows, per_class: int, max_chars: int, id_col: str = "doc_id") -> list[tuple[str, int]]:
    """(text, label) of a bounded sample: about per_class labelled rows of either class with texts of at most max_chars characters.

    The sampled ids (bounded by the class counts) are broadcast, so documents are scanned, not shuffled."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull()).where(train_rows("id"))
    kept, _, bound = class_sample(rows, "y", ["id"], per_class)
    if not bound:
        return []
    ids = kept.groupBy("id").agg(F.max("y").alias("y"), F.min("y").alias("y0")).where("y = y0").select("id", "y").limit(bound)
    texts = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= max_chars)
    return sorted({(r["text"], r["y"]) for r in texts.join(F.broadcast(ids), "id").limit(bound).collect()})


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2500, max_chars: int = 20_000) -> ToxicityModel:
    """Fit on a bounded sample of labelled rows (see labelled) whose id crc32 mod 4 is not 2. Without labels the lexicon is empty."""
    got = labelled(docs, labels, "toxic", lambda c: id_mod(c, 4) != 2, per_class, max_chars)
    return fit([t for t, _ in got], [y for _, y in got])


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score (0 to 1), n_hits, weight. Null and empty texts get the score of a text without hits;
    repeated rows each get a row; no rows give no rows; other columns are not read. The lexicon is bounded by its training
    sample and broadcast; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        match = own.matcher()

        def f(_, texts):
            got = [match(t) for t in texts]
            weight = np.array([g[0] for g in got], float)
            return {"score": pa.array(own.score(weight, [g[1] for g in got])), "n_hits": pa.array([len(g[2]) for g in got], pa.int64()), "weight": pa.array(weight)}

        return f

    return map_texts(docs, id_col, text_col, "score double, n_hits bigint, weight double", make)


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """Rows of docs, all columns, that score under the threshold; one pass, no join. Null and empty texts have no hits and stay."""
    from .language import filter_texts

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        match = own.matcher()

        def f(texts):
            got = [match(t) for t in texts]
            return own.score(np.array([g[0] for g in got], float), [g[1] for g in got]) < threshold

        return f

    return filter_texts(docs, text_col, make)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(id_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_hits")
