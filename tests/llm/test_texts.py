"""Operators that map texts: licences, audio, pieces, classifiers."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strandline.llm import audio, language, licenses, pieces, quality, toxicity
from strandline.llm.common import slices, table

from .conftest import EDGE, SF

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower_ascii(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def brute_licenses(t):
    w = WORD.findall(lower_ascii(t))
    hits = [(i, label) for p, label in licenses.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(hits), min([i for i, _ in hits], default=None), max([i for i, _ in hits], default=None), ",".join(sorted({x for _, x in hits}))


def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def test_license_query_against_brute_force(spark):
    got = {r.doc_id: r for r in licenses.op1_license_scan(spark, SF).collect()}
    docs = documents()
    assert len(got) == len(docs)
    for d in docs:
        r = got[d["doc_id"]]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(d["text"])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert any(r.n_base for r in got.values())


@pytest.mark.parametrize("text", ["Under the MIT License under the mit-license", "xunder the mit license", "apache license, version 2.0 cc by-nc CC BY NC", "ÀUNDER the MIT License", "under the mit under the mit license", "cc by nc" * 3, "cc by nc cc by nc\x85cc by nc"])
def test_license_places(text):
    r = licenses.scanner()(text)
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], ",".join(r["base_labels"])) == brute_licenses(text)


@pytest.mark.parametrize("expression, rpn, choices", [
    ("MIT", ["mit"], [{"mit"}]), ("MIT OR Apache-2.0 AND BSD-3-Clause", ["mit", "apache-2.0", "bsd-3-clause", "and", "or"], [{"mit"}, {"apache-2", "bsd"}]),
    ("(MIT OR X) AND Y", ["mit", "x", "or", "y", "and"], [{"mit", "y"}, {"x", "y"}]), ("GPL-2.0 WITH Classpath-exception-2.0 OR MIT", ["gpl-2.0", "classpath-exception-2.0", "with", "mit", "or"], [{"gpl-2-with-classpath-exception-2.0"}, {"mit"}]),
    ("MIT # a comment", ["mit"], [{"mit"}]), ("MIT OR", None, None), ("(MIT", None, None), ("", None, None), ("MIT) and more", ["mit"], [{"mit"}]), ("AND MIT", None, None), ("(MIT) WITH x", None, None), ("MIT WITH (x)", None, None),
])
def test_shunting_yard(expression, rpn, choices):
    assert licenses.parse_expression(expression) == rpn
    if rpn:
        assert [set(c) for c in licenses.choices(rpn)] == choices


def test_wide_expressions_are_evaluated_without_a_list_of_choices():
    e = licenses.evaluate(licenses.parse_expression(" AND ".join(f"(a{i} OR b{i})" for i in range(4000)) + " AND mit"))
    assert len(e.possible) == 8001 and e.required == {"mit"} and not e.usable


def random_expression(rng, depth):
    if not depth or rng.random() < 0.3:
        return rng.choice(["MIT", "Apache-2.0", "GPL-3.0-only", "ISC", "X-1"]) + (" WITH E-1" if rng.random() < 0.1 else "")
    return f" {rng.choice(['AND', 'OR'])} ".join(f"({random_expression(rng, depth - 1)})" if rng.random() < 0.6 else random_expression(rng, depth - 1) for _ in range(rng.randrange(2, 4)))


def test_evaluation_against_all_choices():
    rng = random.Random(5)
    for _ in range(300):
        rpn = licenses.parse_expression(random_expression(rng, 3))
        if rpn is None:  # a group WITH an exception is not of the grammar
            continue
        every = set(licenses.choices(rpn))
        e = licenses.evaluate(rpn)
        assert e.possible == set().union(*every)
        # Required: no choice is left without it. Choices of which another is a part do not count.
        least = [c for c in every if not any(d < c for d in every)]
        assert e.required <= frozenset.intersection(*every) and all(x in c for c in least for x in e.required)
        plain = lambda c: {x.split("-with-")[0] for x in c}
        assert e.usable == any(plain(c) <= licenses.PERMISSIVE for c in every)
        again = licenses.parse_expression(str(e).replace("-with-", " WITH "))
        assert set(map(frozenset, licenses.choices(again))) >= set(least)


def test_planted_tags_reach_the_query(spark, tmp_path):
    texts = [
        "# SPDX-License-Identifier: MIT OR GPL-3.0-or-later", "(SPDX-License-Identifier: MIT)", "/* SPDX-License-Identifier: (MIT AND LGPL-2.1-only) */ under the MIT license",
        "SPDX-License-Identifier: BSD-3-Clause\nSPDX-License-Identifier: Apache-2.0 OR MIT", "SPDX-License-Identifier: ", None, "plain",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.labels, r.required_labels, r.expressions, r.usable) for r in licenses.op1_license_scan(spark, str(tmp_path)).collect()}
    assert got == {
        0: ("gpl-3,mit", "", "gpl-3 OR mit", True), 1: ("mit", "mit", "mit", True), 2: ("lgpl,mit", "lgpl,mit", "lgpl AND mit", False), 3: ("apache-2,bsd,mit", "bsd", "bsd; apache-2 OR mit", True),
        4: ("", "", "", None), 5: ("", "", "", None), 6: ("", "", "", None),
    }


def test_audio_query_round_trip(spark):
    got = {r.doc_id: r for r in audio.op2_audio_features(spark, SF).collect()}
    by_text = {}
    for d in documents():
        r, raw = got[d["doc_id"]], (d["text"] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = audio.to_wav(payload)
        assert audio.from_wav(media) == (audio.RATE, payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert by_text.setdefault(d["text"], r.feature) == r.feature
    assert len(set(by_text.values())) > 0.9 * len(by_text)


def test_audio_blocks_do_not_show(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 100_000, dtype=np.uint8).tobytes()
    whole = audio.Features().logmel(data)
    monkeypatch.setattr(audio, "BLOCK", 1 << 10)
    parts = audio.Features().logmel(data)
    assert whole.shape == parts.shape and np.allclose(whole, parts, atol=1e-3)


def test_polyphase_keeps_a_tone_and_segments_find_it():
    t = np.arange(60_000) / audio.RATE
    loud = (t > 2) & (t < 3)
    x = (128 + 100 * np.sin(2 * np.pi * 1000 * t) * loud + np.random.default_rng(0).normal(0, 2, len(t))).clip(0, 255).astype(np.uint8)
    y = audio.Features().resample((x.astype(np.float32) - 128) / 128)
    spectrum = np.abs(np.fft.rfft(y * np.hanning(len(y))))
    assert abs(spectrum.argmax() * (audio.RATE * audio.UP / audio.DOWN) / len(y) - 1000) < 2
    spans = [(a, b) for a, b, _ in audio.Features().clip(audio.to_wav(x.tobytes()))]
    assert len(spans) == 1 and abs(spans[0][0] - 2) < 0.1 and abs(spans[0][1] - 3) < 0.1
    import pyarrow as pa

    stored = audio.store_segments([audio.Features().clip(audio.to_wav(x.tobytes())), []])
    assert pa.ipc.open_stream(stored[0]).schema.field("logmel").type.shape == [audio.TENSOR, audio.MELS]
    start, end, tensors = audio.read_segments(stored[0])
    assert (start[0], end[0]) == spans[0] and tensors.shape == (1, audio.TENSOR, audio.MELS)
    assert audio.read_segments(stored[1])[2].shape == (0, audio.TENSOR, audio.MELS)


def test_features_against_a_plain_rendering():
    """Resampling by zero-stuffing and one filter, a DFT by its sum, the mel bank by triangles, segments by a state machine."""
    rng = np.random.default_rng(1)
    raw = np.concatenate([rng.integers(120, 136, 1500), rng.integers(0, 256, 1700), rng.integers(126, 130, 2500)]).astype(np.uint8)
    x = raw.astype(float) / 128 - 1
    taps = audio.UP * audio.TAPS
    h = np.array([np.sinc((k - (taps - 1) / 2) / audio.DOWN) * (0.54 - 0.46 * np.cos(2 * np.pi * k / (taps - 1))) for k in range(taps)])
    h *= audio.UP / h.sum()
    stuffed = np.zeros(len(x) * audio.UP)
    stuffed[:: audio.UP] = x
    want = np.array([sum(h[k] * stuffed[m * audio.DOWN - k] for k in range(taps) if 0 <= m * audio.DOWN - k < len(stuffed)) for m in range(-(-len(stuffed) // audio.DOWN))])
    f = audio.Features()
    y = f.resample(x.astype(np.float32))
    assert len(y) == len(want) and np.allclose(y, want, atol=1e-5)
    n, hop, rate = audio.FRAME, audio.HOP, audio.RATE * audio.UP / audio.DOWN
    padded = np.concatenate([want, np.zeros(-(len(want) - n) % hop)])
    frames = [padded[i : i + n] for i in range(0, len(padded) - n + 1, hop)]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))
    dft = np.exp(-2j * np.pi * np.outer(np.arange(n // 2 + 1), np.arange(n)) / n)
    power = np.array([np.abs(dft @ ((g - g.mean()) * window)) ** 2 for g in frames])
    mel = lambda v: 2595 * np.log10(1 + v / 700)
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(mel(50), mel(rate / 2), audio.MELS + 2)]
    bank = np.array([[max(0.0, min((b * rate / n - lo) / (mid - lo), (hi - b * rate / n) / (hi - mid))) for lo, mid, hi in zip(edges, edges[1:], edges[2:])] for b in range(n // 2 + 1)])
    plain = np.log(power @ bank + 1e-6)
    got = f.logmel(raw.tobytes())
    assert got.shape == plain.shape and np.abs(got - plain).max() < 0.02
    energy = np.log(np.exp(got).sum(1))
    mean, sd = energy.mean(), energy.std()
    spans, begin, quiet, peak = [], None, 0, -np.inf
    for k, e in enumerate([*energy, *[-np.inf] * 20]):
        if e >= mean - 0.25 * sd - 1e-6:
            begin, peak, end, quiet = (k if begin is None else begin), max(peak, e), k + 1, 0
        elif begin is not None and (quiet := quiet + 1) >= 8:
            spans += [(begin, end)] * int(peak >= mean - 1e-6)
            begin, peak = None, -np.inf
    assert f.segments(got) == spans and spans


def test_pieces_query_returns_ids_that_decode(spark):
    text = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    got = pieces.op4_sentencepiece(spark, SF).collect()
    lattice = pieces.PieceLattice(pieces.piece_model())
    assert {r.doc_id: lattice.decode(r.ids) for r in got} == text and all(len(r.ids) == r.n_pieces for r in got)


def test_pieces_decode_and_do_not_depend_on_partitions(spark, edge):
    docs = table(spark, SF, "documents")
    model = pieces.piece_model()
    a = {r.doc_id: (r.n_pieces, r.ids_crc32, r.lossless) for r in pieces.op4_sentencepiece(spark, SF).collect()}
    b = {r.doc_id: (r.n_pieces, r.ids_crc32, r.lossless) for r in pieces.sample_pieces(docs.repartition(7), model, with_ids=False).collect()}
    assert a == b and all(x[2] for x in a.values())
    back = pieces.decode_pieces(pieces.sample_pieces(edge, model), model).collect()
    assert collections.Counter(r.text for r in back) == collections.Counter(t or "" for _, t, _, _ in EDGE)


def test_piece_samples_follow_the_lattice():
    lattice = pieces.PieceLattice(pieces.piece_model(), theta=1e-4)
    word = " sand"

    def paths(s):
        if not s:
            yield (), 1.0
        for k in range(1, len(s) + 1):
            if s[:k] in lattice.weight:
                i, w = lattice.weight[s[:k]]
                for rest, x in paths(s[k:]):
                    yield (i, *rest), w * x

    p = dict(paths(word))
    total, n = sum(p.values()), 30_000
    seen = collections.Counter(tuple(x.tolist()) for x in lattice.sample(list(range(n)), [word] * n))
    assert len(p) > 5 and set(seen) <= set(p)
    assert max(abs(seen[k] / n - v / total) for k, v in p.items()) < 0.015
    long = "x" * 200
    assert lattice.decode(lattice.sample([1], [long])[0].tolist()) == long
    flat = pieces.PieceLattice(pieces.piece_model(), theta=1e-4)
    assert (flat.sample([9, 2], ["other words first", word * 5])[1] == lattice.sample([2], [word * 5])[0]).all()


def test_long_words_have_the_shares_of_short_ones():
    """Words over pieces._LONG characters are compiled one by one; both ways give the same edges and shares."""
    with pytest.raises(ValueError):
        pieces.PieceLattice(pieces.piece_model(), theta=1.0)
    lattice = pieces.PieceLattice(pieces.piece_model())
    for word in ["x" * 200, "internationalisation" * 12, "naïveœuvre" * 9, "字" * 70 + "word" * 30, "q" * 65]:
        got = []
        for compiled in (lambda: lattice._compile([word]) or lattice.words[word], lambda: lattice._compile_long(word)):
            lattice._reset()
            last, n = compiled(), lattice.n_edges
            got.append((last, lattice.first[: lattice.n_states].copy(), *(x[:n].copy() for x in lattice.flat)))
        (last, first, share, *rest), (last_, first_, share_, *rest_) = got
        assert last == last_ and (first == first_).all() and all((x == y).all() for x, y in zip(rest, rest_, strict=True))
        assert np.allclose(share, share_, rtol=0, atol=1e-9)


def held(mod, rest):
    return lambda i: zlib.crc32(str(i).encode()) % mod == rest


def test_language_held_out_accuracy(spark):
    got = language.op10_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()}
    out = [r for r in got if r.held_out]
    assert len(got) == len(lang) and all(r.held_out == held(4, 2)(r.doc_id) for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in out]) > 0.97


def test_toxicity_held_out(spark):
    got = {r.doc_id: r for r in toxicity.op7_toxicity(spark, "/root/testdata/sf0.1").collect()}
    rows = [r for r in pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pylist() if r["toxic"] is not None and got[r["doc_id"]].held_out]
    hit = [r for r in rows if got[r["doc_id"]].predicted]
    assert np.mean([r["toxic"] for r in hit]) > 0.95
    assert np.mean([got[r["doc_id"]].predicted for r in rows if r["toxic"]]) > 0.92


def test_toxicity_folding_and_exceptions():
    m = toxicity.ToxicityModel({"scum": 5.0, "grape\0": 4.0}, ["scum bag of grapes", "scumble"])
    match = m.matcher()
    n = lambda t: len(match(t)[2])
    assert n("you scum") == n("SCUM!!") == n("ѕсum") == n("5cum") == n("$cum") == n("sc­um") == n("scums") == 1
    assert n("descum") == n("scumble") == n("a scum bag of grapes") == n("grapes") == 0
    assert n("scum grape") == 2
    assert m.score(5.0, 10) > m.score(5.0, 1000) > m.score(0.0, 10)
    assert match("you scum" + " " * 5000)[1] == match("you   \n\t scum!")[1] == 2 and match("")[1] == 0  # words, not separators


def test_spans_that_excuse_are_found_as_by_comparing_all():
    rng = random.Random(4)
    for _ in range(200):
        span = lambda: (b := rng.randrange(40), b + rng.randrange(1, 9))
        found, spans = [(*span(), 1.0) for _ in range(rng.randrange(12))], [span() for _ in range(rng.randrange(12))]
        assert toxicity.outside(found, spans) == [x for x in found if not any(b <= x[0] and x[1] <= e for b, e in spans)]


def test_slices_are_bounded_by_rows_and_bytes():
    texts = ["a" * n for n in (5, 900, 900, 0, 3000, 1, 1, 1, 1, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    parts = list(slices([batch, batch.slice(0, 0)], 4, 1000))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert all(p.num_rows <= 4 and (p.num_rows == 1 or p.nbytes <= 1000) for p in parts)
    assert [p.num_rows for p in slices([batch], 4)] == [4, 4, 2]


def test_toxicity_learns_short_words_and_matches_plainly(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(4, 8)))
    texts = [" ".join(word() for _ in range(30)) for _ in range(600)]
    toxic = [k % 4 == 0 for k in range(600)]
    texts = [t + (" zq" if k % 8 else " vexing") if y else t + " zqa" for k, (t, y) in enumerate(zip(texts, toxic, strict=True))]
    m = toxicity.fit(texts, [int(y) for y in toxic])
    assert "zq\0" in m.lexicon and any("vexing".startswith(w.rstrip("\0")) for w in m.lexicon)

    def plain(text):
        """Each word's longest entry, by trying them all; exceptions cover what lies within them."""
        folded, found = toxicity.fold(text), []
        starts = [i for i in range(len(folded)) if folded[i].isalnum() and (not i or not folded[i - 1].isalnum())]
        ends = lambda w, i: folded.startswith(w, i) and not (i + len(w) < len(folded) and folded[i + len(w)].isalnum())
        excused = [(i, i + len(x)) for x in m.exceptions for i in starts if ends(x, i)]
        for i in starts:
            hits = [w for w in m.lexicon if (ends(w[:-1], i) if w[-1] == "\0" else folded.startswith(w, i))]
            if hits:
                w = max(hits, key=lambda w: (len(w.rstrip("\0")), -len(w)))
                if not any(a <= i and i + len(w.rstrip("\0")) <= b for a, b in excused):
                    found.append((i, i + len(w.rstrip("\0"))))
        return found, len(re.findall(r"[^\W_]+", folded))

    match = m.matcher()
    for t in [*texts[:80], "ZQ zq. z9 2q vex1ng VEXING! vexingly xvexing zq" + " a" * 50, ""]:
        weight, words, spans = match(t)
        assert (sorted((b, e) for b, e, _ in spans), words) == plain(t)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, m).collect()}
    assert np.mean([(got[k] >= 0.3) == y for k, y in enumerate(toxic)]) > 0.98


def test_quality_against_a_plain_forward_pass():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "Beta", "gamma", "DELTA", "eps", "7"]) for _ in range(rng.randrange(1, 30))) + ("." if k % 2 else " !!! ???") for k in range(200)]
    model = quality.fit(texts, [k % 2 for k in range(200)])
    table_, vocabulary = model.vectors.table, model.vectors.vocabulary

    def plain(text):
        tokens = re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+|\n", text)
        rows = [vocabulary.get(t.lower(), len(vocabulary) + zlib.crc32(t.lower().encode()) % quality.BUCKETS) for t in tokens]
        v = [[float(x) for x in table_[r]] for r in rows]
        mean = [sum(c) / len(rows) for c in zip(*v)]
        spread = [max(0.0, sum(x * x for x in c) / len(rows) - m * m) ** 0.5 for c, m in zip(zip(*v), mean)]
        kinds = [sum(quality.shape(t) == k for t in tokens) / len(tokens) for k in range(len(quality.SHAPES))]
        same = sum(a == b for a, b in zip(rows, rows[1:])) / (len(rows) - 1) if len(rows) > 1 else 0.0
        x = [*mean, *spread, *kinds, len(set(rows)) / len(rows), same, np.log1p(len(rows)) / 10, len(text) / len(rows) / 10]
        w1, b1, w2, b2 = model.layers
        z = [(a - m) / s for a, m, s in zip(x, model.mean, model.scale)]
        hidden = [np.tanh(sum(z[i] * w1[i, j] for i in range(len(z))) + b1[j]) for j in range(len(b1))]
        return 1 / (1 + np.exp(-(sum(h * w for h, w in zip(hidden, w2)) + b2[0] + model.bias) / model.temperature))

    few = texts[:10] + ["unseen wörds HERE\nand 12 __ there", "x y"]
    assert np.allclose(model.score(few), [plain(t) for t in few], atol=1e-4)
    a, sign = quality.index_vector("alpha")
    assert len(set(a.tolist())) == quality.NONZERO and set(sign.tolist()) <= {-1, 1}


def test_language_kernel_against_sets():
    """Margins by sets of n-grams and explicit ridge regression on Nystroem features."""
    words = {"aa": ["der", "und", "nicht", "schon"], "bb": ["the", "and", "with", "from"], "cc": ["les", "dans", "avec", "pour"]}
    rng = random.Random(1)
    texts, langs = zip(*[(" ".join(rng.choice(words[x]) for _ in range(rng.randrange(2, 9))), x) for x in "aa bb cc".split() for _ in range(20)], strict=True)
    m = language.fit(list(texts), list(langs), n_landmarks=6)
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    kernel = lambda a, b: len(grams(a) & grams(b)) / (len(grams(a)) * len(grams(b))) ** 0.5
    land = [t for x in ("aa", "bb", "cc") for t in [t for t, y in zip(texts, langs, strict=True) if y == x][:6]]
    k = np.array([[kernel(a, b) for b in land] for a in land])
    values, vectors = np.linalg.eigh(k)
    root = vectors[:, values > 1e-6 * values.max()] / np.sqrt(values[values > 1e-6 * values.max()])
    phi = np.array([[kernel(t, b) for b in land] for t in texts]) @ root
    y = np.array([[1.0 if x == c else -1.0 for c in ("aa", "bb", "cc")] for x in langs])
    a = phi / np.sqrt(20)
    w = np.linalg.solve(a.T @ phi + 1e-2 * np.eye(phi.shape[1]), a.T @ y)
    tried = [*texts[:5], "mit der und", "dans the", "nicht with les", "q"]
    want = np.array([[kernel(t, b) for b in land] for t in tried]) @ root @ w
    assert np.allclose(m.margins(tried), want, atol=0.02)  # up to float products and hash collisions
    assert m.predict(["dans les avec pour", "123", "²½①", ""])[0] == ["cc", "und", "und", "und"]


def test_language_takes_every_class_and_rejects_what_is_none(spark):
    many = [(k * 400 + j, f"{chr(0x4E00 + 7 * k)}{chr(0x4E00 + 7 * k + 1)} " * 5, f"l{k}") for k in range(300) for j in range(2)]
    model = language.train(spark.createDataFrame(many, "doc_id bigint, text string, lang string"), per_class=4)
    assert len(model.languages) > 280  # ids of the held-out quarter are not trained on
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = language.train(docs)
    rng = random.Random(0)
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for n in (100, 300, 3000)]
    junk += ["Привет мир как дела сегодня", "中文 文本 例子 这里", "for (int i = 0; i < n; ++i) { x[i] = y[i] * 2; } return std::move(x);", "4f" * 20 + "".join(f"{rng.randrange(256):02x}" for _ in range(300)), "²½①", "", None]
    kept = language.keep_identified(docs.unionByName(spark.createDataFrame([(-k - 1, t, None, None, 0) for k, t in enumerate(junk)], docs.schema)), model)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert min(ids) >= 0 and len(ids) == docs.count()


def test_quality_held_out(spark):
    got = {r.doc_id: r for r in quality.op6_quality(spark, "/root/testdata/sf0.1").collect()}
    rows = [r for r in pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pylist() if r["quality"] is not None and got[r["doc_id"]].held_out]
    s, y = np.array([got[r["doc_id"]].score for r in rows]), np.array([r["quality"] for r in rows])
    assert (s[y == 1][:, None] > s[y == 0][None, :]).mean() > 0.97
    assert np.mean((s >= 0.3) == y) > 0.95
    assert abs(s.mean() - y.mean()) < 0.08  # calibrated
    assert held(5, 0)(rows[0]["doc_id"]) and all(got[r["doc_id"]].held_out == held(5, 0)(r["doc_id"]) for r in rows)


def test_edges_of_the_maps(spark, edge, none):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    lang = language.train(edge)
    ops = [
        licenses.scan_licenses, audio.audio_features, lambda d: pieces.sample_pieces(d, pieces.piece_model()), lambda d: language.identify(d, lang), lambda d: language.identify(d, language.fit([], [])),
        lambda d: toxicity.score_toxicity(d, toxicity.train(d, labels)), lambda d: quality.score_quality(d, quality.train(d, labels)),
    ]
    for op in ops:
        assert op(none).count() == 0
        got = op(edge).collect()
        assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in EDGE)
    pred = {r.doc_id: r for r in language.identify(edge, lang).collect()}
    assert [pred[i].lang_pred for i in (1, 2, 3, 8)] == ["und"] * 4 and pred[6].lang_pred in ("en", "fr")
    kept = language.keep_identified(edge, lang)
    assert kept.columns == edge.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id and r.doc_id != 7) == [4, 5, 5]
    assert [r.lang in ("en", "fr") for r in kept.collect() if r.doc_id == 5] == [True, True]  # a null language is filled
    assert language.keep_identified(edge, language.fit([], [])).count() == 0 and language.keep_identified(none, lang).count() == 0
    assert toxicity.keep_clean(edge, toxicity.ToxicityModel({"three": 9.0})).count() == 6
