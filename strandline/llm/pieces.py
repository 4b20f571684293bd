"""SentencePiece sampling: forward filtering, backward sampling over the piece lattice, seeded by row key; lossless decoding.

Text is cut before each run of spaces and where letters meet other characters; no piece of the vocabulary spans such a cut, so
the lattice of a text is the chain of its words' lattices. Forward weights are computed once per distinct word, for all new
words of a batch at once, and kept as one flat automaton; backward sampling then steps all words of a batch at once, a
piece at a time."""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

_WORD = re.compile(r" *(?:[^\W\d_]+|(?:[\d_]|[^\w ])+)| +")
_LONG = 64  # longer words are compiled one by one: see _compile_long
_MIX1, _MIX2, _GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def uniform(x: np.ndarray) -> np.ndarray:
    """splitmix64 of a counter, as doubles in [0, 1)."""
    with np.errstate(over="ignore"):
        z = x * _GOLDEN
        z = (z ^ (z >> np.uint64(30))) * _MIX1
        z = (z ^ (z >> np.uint64(27))) * _MIX2
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(np.float64) * 2.0**-53


class PieceLattice:
    """theta scales the piece scores: 0 samples segmentations uniformly, larger values lean to the best one. A theta with which
    weights would leave the range of doubles (of this vocabulary above about 0.0013) is refused."""

    def __init__(self, model_file: str, theta: float = 1e-3, most_words: int = 300_000, most_states: int = 6_000_000) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = [0] * 256
        self.weight: dict[str, tuple[int, float]] = {}
        lowest = 0.0
        for i in range(n):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_id[b], self.bytes_of[i] = i, bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                surface = sp.id_to_piece(i).replace("▁", " ")
                if not _WORD.fullmatch(surface):
                    continue  # would span a cut: in this vocabulary only a superscript two with a full stop
                self.bytes_of[i] = surface.encode()
                score = max(sp.get_score(i), -float(n))  # runs of spaces carry a placeholder score far below all ranks
                self.weight[surface] = (i, float(np.exp(theta * score)))
                lowest = min(lowest, score)
        self.byte_weight = float(np.exp(theta * (lowest - 1)))
        self.longest = max(map(len, self.weight))
        if abs(theta) * (1 - lowest) * self.longest > 690:  # one long piece against as many short ones: see _compile_long
            raise ValueError(f"theta {theta} takes weights out of the range of doubles")
        self.prefixes = {w[:k] for w in self.weight for k in range(1, len(w) + 1)}
        self._trie()
        self.most_words, self.most_states = most_words, most_states
        self._reset()

    def _reset(self) -> None:
        self.words: dict[str, int] = {}  # word -> its last state
        # The edges of a state lie together from first[state] on, with running shares up to 1; state 0 starts every word.
        self.flat, self.n_edges, self.n_states = (np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int32)), 0, 0
        self.first = np.zeros(0, np.int64)
        self._append(np.zeros(1, np.int64), np.ones(1), np.zeros(1, np.int64), np.full(1, -1))

    def _append(self, heads: np.ndarray, *new: np.ndarray) -> None:
        """Add states, given by their first new edges, and edges to the arrays (share, previous state, piece); capacity doubles."""
        n, end = self.n_edges, self.n_edges + len(new[0])
        states = self.n_states + len(heads)
        if states > len(self.first):
            self.first = np.concatenate([self.first, np.zeros(max(2 * states, 1 << 16) - len(self.first), np.int64)])
        self.first[self.n_states : states] = n + heads
        self.n_states = states
        if end > len(self.flat[0]):
            size = max(2 * end, 1 << 16)
            grown = tuple(np.zeros(size, a.dtype) for a in self.flat)
            for old, array in zip(self.flat, grown, strict=True):
                array[:n] = old[:n]
            self.flat = grown
        for array, x in zip(self.flat, new, strict=True):
            array[n:end] = x
        self.n_edges = end

    def _trie(self) -> None:
        """The pieces as arrays: (node, character) -> node by binary search, and each node's piece and weight."""
        nodes = {w: i + 1 for i, w in enumerate(sorted(self.prefixes))}
        chars = sorted({w[-1] for w in nodes})
        self.char_of = np.zeros(0x110000, np.int64)
        self.char_of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.n_chars = len(chars) + 1
        keys = np.array([nodes.get(w[:-1], 0) * self.n_chars + self.char_of[ord(w[-1])] for w in nodes], np.int64)
        order = np.argsort(keys)
        self.step_key, self.step_node = keys[order], np.array(list(nodes.values()), np.int64)[order]
        self.roots = np.zeros(self.n_chars, np.int64)  # the first step, by direct look-up
        self.roots[self.step_key[self.step_key < self.n_chars]] = self.step_node[self.step_key < self.n_chars]
        self.node_piece, self.node_weight = np.full(len(nodes) + 1, -1, np.int32), np.zeros(len(nodes) + 1)
        for w, (i, x) in self.weight.items():
            self.node_piece[nodes[w]], self.node_weight[nodes[w]] = i, x

    def _compile(self, new: list[str]) -> None:
        """Forward filtering of all new words together, position by position: alpha sums the weights of all paths to a
        position, in long doubles; each state keeps the running shares of its in-edges. Every sum runs within one word in a
        fixed order, so a word's shares do not depend on its batch."""
        text = "".join(new)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.array([len(w) for w in new], np.int64)
        begin = np.repeat(np.cumsum(lengths) - lengths, lengths)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(code))
        chars, base = self.char_of[code], self.n_states
        at, depth, found = np.arange(len(code)), 0, []
        while len(at):
            if depth:
                key = node * self.n_chars + chars[at + depth]
                place = np.minimum(np.searchsorted(self.step_key, key), len(self.step_key) - 1)
                ok = (self.step_key[place] == key) & (chars[at + depth] > 0)
                at, node = at[ok], self.step_node[place[ok]]
            else:
                node = self.roots[chars]
                at = np.flatnonzero(node)
                node = node[at]
            depth += 1
            full = self.node_piece[node] >= 0
            found.append((at[full], at[full] + depth, self.node_piece[node[full]], self.node_weight[node[full]]))
            if depth == 1:
                bare = np.ones(len(code), bool)
                bare[at[full]] = False
                bare = np.flatnonzero(bare)  # byte pieces stand for one character
                found.append((bare, bare + 1, (-2 - code[bare]).astype(np.int32), np.full(len(bare), self.byte_weight)))
            more = left[at] > depth
            at, node = at[more], node[more]
        start, end, piece, weight = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((start, end))
        start, end, piece, weight = start[order], end[order], piece[order], weight[order].astype(np.longdouble)
        heads = np.flatnonzero(np.diff(end, prepend=-1))
        sizes = np.diff(heads, append=len(end))
        step = (end - begin[end - 1])[heads]  # position within the word
        first = start == begin[start]
        alpha, cum = np.zeros(len(code), np.longdouble), np.zeros(len(end), np.longdouble)
        for j in range(1, int(lengths.max()) + 1):
            head = heads[step == j]
            size = sizes[step == j]
            run = np.zeros(len(head), np.longdouble)
            for r in range(int(size.max()) if len(head) else 0):
                live = size > r
                e = head[live] + r
                run[live] += np.where(first[e], 1, alpha[start[e] - 1]) * weight[e]
                cum[e] = run[live]
            alpha[end[head] - 1] = run
        share = (cum / alpha[end - 1]).astype(np.float64)
        share[np.append(heads[1:], len(end)) - 1] = 1.0
        self._append(heads, share, np.where(first, 0, base + start - 1), piece)
        for w, last in zip(new, (base + np.cumsum(lengths) - 1).tolist(), strict=True):
            self.words[w] = last

    def _compile_long(self, word: str) -> int:
        """The same for one word of any length: weights are scaled back whenever they leave the range of doubles."""
        n, base = len(word), self.n_states
        alpha = [0.0] * (n + 1)
        alpha[0] = 1.0
        edges: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
        weight, prefixes, longest = self.weight, self.prefixes, self.longest
        for i in range(n):
            while not 1e-100 < alpha[i] < 1e100:  # only ratios within one piece length matter
                scale = 1e-100 if alpha[i] > 1 else 1e100
                for k in range(i, min(n, i + longest) + 1):
                    alpha[k] *= scale
                    edges[k] = [(p, q, w * scale) for p, q, w in edges[k]]
            a, single = alpha[i], False
            for j in range(i + 1, min(n, i + longest) + 1):
                s = word[i:j]
                if s not in prefixes:
                    break
                hit = weight.get(s)
                if hit is not None:
                    w = a * hit[1]
                    alpha[j] += w
                    edges[j].append((i, hit[0], w))
                    single |= j == i + 1
            if not single:
                w = a * self.byte_weight
                alpha[i + 1] += w
                edges[i + 1].append((i, -2 - ord(word[i]), w))
        heads, share, prev, piece = [], [], [], []
        for j in range(1, n + 1):
            heads.append(len(share))
            run, scale = 0.0, 1 / sum(w for _, _, w in edges[j])
            for p, q, w in edges[j]:
                run += w * scale
                share.append(run)
                prev.append(p and base + p - 1)
                piece.append(q)
            share[-1] = 1.0
        self._append(np.array(heads), np.array(share), np.array(prev), np.array(piece))
        return base + n - 1

    def sample(self, keys: list[int], texts: list[str]) -> list[np.ndarray]:
        """Ids of one sampled segmentation per text; equal (key, text) give equal ids whatever else is in the batch."""
        if len(self.words) > self.most_words or self.n_states > self.most_states:  # a state for each character of the words kept
            self._reset()
        words, split = self.words, [_WORD.findall(t) for t in texts]
        counts = [len(w) for w in split]
        flat = [x for w in split for x in w]
        new = [x for x in dict.fromkeys(flat) if x not in words]
        for x in new:
            if len(x) > _LONG:
                words[x] = self._compile_long(x)
        if new := [x for x in new if len(x) <= _LONG]:
            self._compile(new)
        states = list(map(words.__getitem__, flat))
        (share, prev, piece), first_edge = self.flat, self.first
        state, word = np.array(states, np.int64), np.arange(len(states))
        starts = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        doc = np.repeat(np.arange(len(texts)), counts)
        with np.errstate(over="ignore"):
            seeds = (uniform(np.array([k & (2**64 - 1) for k in keys], np.uint64) + np.uint64(1)) * 2.0**53).astype(np.uint64) << np.uint64(11)
            counter = seeds[doc] + (word - starts[doc]).astype(np.uint64) * np.uint64(1 << 24)
        out_word, out_piece, steps = [], [], 0
        while len(state):
            with np.errstate(over="ignore"):
                u = uniform(counter + np.uint64(steps))
            edge = first_edge[state]
            at = np.flatnonzero(share[edge] <= u)
            while len(at):  # few edges a state: step on where the share is still under the draw
                edge[at] += 1
                at = at[share[edge[at]] <= u[at]]
            out_word.append(word)
            out_piece.append(piece[edge])
            state = prev[edge]
            live = state > 0
            state, word, counter = state[live], word[live], counter[live]
            steps += 1
        if not out_word:
            return [np.zeros(0, np.int64) for _ in texts]
        w, p = np.concatenate(out_word[::-1]), np.concatenate(out_piece[::-1]).astype(np.int64)
        order = np.argsort(w, kind="stable")  # a word's pieces come last to first: reversed steps restore their order
        ends = np.searchsorted(w[order], starts)
        p = p[order]
        return [self._with_bytes(p[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _with_bytes(self, p: np.ndarray) -> np.ndarray:
        if not len(p) or p.min() >= 0:
            return p
        out: list[int] = []
        for x in p.tolist():
            out += [x] if x >= 0 else [self.byte_id[b] for b in chr(-2 - x).encode("utf-8", "replace")]
        return np.array(out, np.int64)

    def decode(self, ids) -> str:
        """The exact text: pieces and byte pieces are joined as bytes, with no normalisation in either direction."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode()


@lru_cache(maxsize=1)
def _lattice(model_file: str, theta: float = 1e-3) -> PieceLattice:
    """One for all tasks of a Python worker; what it keeps is bounded and does not change its results."""
    return PieceLattice(model_file, theta)


def sample_pieces(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", theta: float = 1e-3, with_ids: bool = True) -> DataFrame:
    """One row per input row: the sampled piece ids (with_ids), their count and CRC-32, and whether decoding gave the text back.

    The sample depends on the row key and the text alone (crc32 of the key's text seeds it), not on partitions or batches; a
    null key counts as the empty text. Null and empty texts give no pieces and decode to ''. Characters outside the vocabulary
    and a literal U+2581 go through byte pieces, so decode(ids) is the text. Repeated rows each get a row with equal ids; no
    rows give no rows; other columns are not read. A map over the scan without shuffle; a worker keeps at most 300,000
    words of six million characters beside a batch's."""

    def make():
        lattice = _lattice(model_file, theta)

        def f(keys, texts):
            ids = lattice.sample([zlib.crc32(("" if k is None else str(k)).encode()) for k in keys], texts)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
            back = [lattice.decode(x.tolist()) for x in ids]
            cols = {
                "ids": lists, "n_pieces": pa.array([len(x) for x in ids], pa.int64()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), "text_crc32": pa.array([zlib.crc32(b.encode("utf-8", "replace")) for b in back], pa.int64()),
                "lossless": pa.array([b == t for b, t in zip(back, texts, strict=True)]),
            }
            return cols

        return f

    schema = "ids array<int>, " * with_ids + "n_pieces bigint, n_chars bigint, ids_crc32 bigint, text_crc32 bigint, lossless boolean"
    return map_texts(docs, id_col, text_col, schema, make, rows=512)


def decode_pieces(df: DataFrame, model_file: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Text of each row's ids; null ids give null. Other columns stay (one named out_col is replaced)."""

    @F.pandas_udf("string")
    def decode(ids):
        lattice = _lattice(model_file)
        return ids.map(lambda x: None if x is None else lattice.decode(list(x)))

    return df.withColumn(out_col, decode(F.col(ids_col)))


def piece_model(path: str | None = None) -> str:
    """The vocabulary file: a parameter; by default the piece_bpe_32k model of the installed public vocabularies."""
    import public_tokenizers

    return path or public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_pieces(table(spark, sf_dir, "documents"), piece_model())
