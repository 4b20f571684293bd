"""License scans: Aho-Corasick over identifier tags and notice phrases, a shunting-yard parser for licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .ahocorasick import spaced_words, word_automaton
from .common import map_texts, table

# Phrases and labels that the query's contract names.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Notice phrases beside the base ones: label and weight of evidence.
NOTICES = {
    "gnu general public license version 3": ("gpl-3", 0.95),
    "gnu general public license version 2": ("gpl-2", 0.95),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.95),
    "redistribution and use in source and binary forms": ("bsd", 0.95),
    "boost software license": ("bsl", 0.9),
    "creative commons attribution": ("cc-by", 0.8),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by nd": ("cc-by-nd", 0.8),
    "released into the public domain": ("public-domain", 0.8),
    "all rights reserved": ("proprietary", 0.6),
}

#: Families of licence identifiers and the labels that phrases have for them; longer beginnings come before shorter ones.
FAMILIES = {
    "mit": "mit", "apache-2.0": "apache-2", "cc-by-nc-sa": "cc-by-nc-sa", "cc-by-nc-nd": "cc-by-nc-nd", "cc-by-nc": "cc-by-nc", "cc-by-sa": "cc-by-sa", "cc-by-nd": "cc-by-nd", "cc-by": "cc-by",
    "gpl-3.0": "gpl-3", "gpl-2.0": "gpl-2", "lgpl": "lgpl", "agpl": "agpl", "mpl": "mpl", "epl": "epl", "bsd": "bsd", "bsl": "bsl", "cc0": "public-domain", "unlicense": "public-domain",
}

#: Labels that ask for a notice at most: the default of what an expression is evaluated against.
PERMISSIVE = frozenset({"mit", "apache-2", "bsd", "bsl", "cc-by", "public-domain", "isc", "zlib"})

_TAG = "spdx license identifier"
_TAG_LINE = re.compile(r"SPDX[^0-9A-Za-z]+License[^0-9A-Za-z]+Identifier\s*:\s*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+\-]*")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def parse_expression(expression: str) -> list[str] | None:
    """Shunting-yard: the expression's leading well-formed tokens in reverse Polish order; None if there is no expression or it
    ends inside one. What follows a complete expression is a comment, and so is a ')' that nothing opened."""
    out: list[str] = []
    ops: list[str] = []
    operand, named = True, False  # what the grammar wants next; whether the last token names a licence, as 'with' asks for
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low in _PRECEDENCE:
            if operand or low == "with" and not named:
                return None
            while ops and ops[-1] != "(" and _PRECEDENCE[ops[-1]] >= _PRECEDENCE[low]:
                out.append(ops.pop())
            ops.append(low)
            operand, named = True, False
        elif token == "(":
            if not operand:
                break
            if ops and ops[-1] == "with":
                return None
            ops.append(token)
        elif token == ")":
            if operand:
                return None
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                break
            ops.pop()
            named = False
        elif operand:
            named = not (ops and ops[-1] == "with")  # an exception takes no further exception
            out.append(low)
            operand = False
        else:
            break
    if operand or "(" in ops:
        return None
    return out + ops[::-1]


_SUFFIX = re.compile(r"(-only|-or-later|\+)$")


def label_of(identifier: str) -> str:
    """The label of a licence identifier in lower case: that of its family where notices have one, else the identifier."""
    for family, label in FAMILIES.items():
        if identifier == family or identifier.startswith(family + "-"):
            return label
    return _SUFFIX.sub("", identifier)


@dataclass
class Evaluated:
    """A licence expression as evaluated: its operands at the top (`op` joins them), every licence that some choice holds, those
    that each choice holds, and whether some choice holds allowed licences alone. Each is kept up operator by operator, so no
    list of choices, of which there may be exponentially many, is made."""

    op: str
    operands: set[str]
    possible: set[str]
    required: set[str]
    usable: bool

    def __str__(self) -> str:
        return f" {self.op.upper()} ".join(sorted(self.operands))

    def inside(self, op: str) -> set[str]:
        """Operands as part of an `op`: those of the same operator join it, others stay in parentheses."""
        return self.operands if len(self.operands) == 1 or self.op == op else {f"({self})"}


def evaluate(rpn: list[str], allowed: frozenset[str] = PERMISSIVE) -> Evaluated:
    """'or' offers either side, 'and' asks for both, 'with' names an exception of a licence, which only adds permissions."""
    stack: list[Evaluated] = []
    for token in rpn:
        if token not in _PRECEDENCE:
            label = label_of(token)
            stack.append(Evaluated("", {label}, {label}, {label}, label in allowed))
            continue
        b, a = stack.pop(), stack.pop()
        if token == "with":
            (x,), (y,) = a.possible, b.possible
            label = f"{x}-with-{y}"
            stack.append(Evaluated("", {label}, {label}, {label}, a.usable))
            continue
        small, large = sorted((a, b), key=lambda e: len(e.operands) if e.op == token else 1)
        operands = large.inside(token)
        operands |= small.inside(token)
        possible, other = sorted((a.possible, b.possible), key=len, reverse=True)
        possible |= other
        if token == "or":
            stack.append(Evaluated(token, operands, possible, a.required & b.required, a.usable or b.usable))
        else:
            stack.append(Evaluated(token, operands, possible, a.required | b.required, a.usable and b.usable))
    return stack[0]


def choices(rpn: list[str]) -> Iterator[frozenset[str]]:
    """The alternative sets of licences that satisfy an expression, one at a time; the same set may come again."""
    stack: list[tuple] = []
    for token in rpn:
        if token not in _PRECEDENCE:
            stack.append((label_of(token),))
        else:
            b, a = stack.pop(), stack.pop()
            stack.append((f"{a[0]}-with-{b[0]}",) if token == "with" else (token, a, b))

    def each(node: tuple) -> Iterator[frozenset[str]]:
        if len(node) == 1:
            yield frozenset(node)
        elif node[0] == "or":
            yield from each(node[1])
            yield from each(node[2])
        else:
            for p in each(node[1]):
                for q in each(node[2]):
                    yield p | q

    return each(stack[0])


def scanner(allowed: frozenset[str] = PERMISSIVE):
    phrases: dict[str, list] = {}
    for p, label in BASE_PHRASES.items():
        phrases[p] = ("base", label, 1.0)
    for p, (label, weight) in NOTICES.items():
        phrases[p] = ("notice", label, weight)
    phrases[_TAG] = ("tag", "", 1.0)
    automaton = word_automaton(phrases)

    def scan(text: str) -> dict:
        words = spaced_words(text)
        starts, base, more, places, tagged, miss = [], set(), set(), [], False, 1.0
        at, seen = 0, 0
        for end, ((kind, label, weight), phrase) in sorted(automaton.iter(words), key=lambda m: m[0] - len(m[1][1])):
            begin = end - len(phrase) - 1  # of the space before the phrase
            seen, at = seen + words.count(" ", at, begin), begin
            if kind == "tag":
                tagged = True
                continue
            places.append((seen, label, phrase))
            miss *= 1 - min(weight, 0.999)
            if kind == "base":
                starts.append(seen)
                base.add(label)
            else:
                more.add(label)
        expressions = []
        if tagged:
            for m in _TAG_LINE.finditer(text):
                rpn = parse_expression(m[1])
                if rpn is None:
                    continue
                e = evaluate(rpn, allowed)
                expressions.append({"expression": m[1].strip(), "evaluated": str(e), "possible": sorted(e.possible), "required": sorted(e.required), "usable": e.usable})
                more |= e.possible
                miss *= 0.001
        return {
            "n_words": words.count(" ") - 1, "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": sorted(base), "labels": sorted(base | more), "score": 1.0 - miss,
            "places": [{"word": w, "label": x, "phrase": p} for w, x, p in places], "expressions": expressions,
        }

    return scan


_SCHEMA = {
    "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "array<string>", "labels": "array<string>", "score": "double",
    "places": "array<struct<word:bigint,label:string,phrase:string>>", "expressions": "array<struct<expression:string,evaluated:string,possible:array<string>,required:array<string>,usable:boolean>>",
}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: frozenset[str] = PERMISSIVE) -> DataFrame:
    """One row per input row: word count, places of licence phrases (word index, label), tag expressions as evaluated (licences
    of some choice, licences of every choice, whether `allowed` ones suffice), labels, score.

    Base phrases come from BASE_PHRASES; NOTICES and SPDX-style tags only add labels. Null and empty texts give 0 words,
    null first/last, empty lists and score 0. Repeated rows each get a row; no rows give no rows; other columns are not read.
    A map over the scan: no shuffle, each task holds one text's matches at a time."""
    import pyarrow as pa

    kinds = {
        "base_labels": pa.list_(pa.string()), "labels": pa.list_(pa.string()), "score": pa.float64(),
        "places": pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()), ("phrase", pa.string())])),
        "expressions": pa.list_(pa.struct([("expression", pa.string()), ("evaluated", pa.string()), ("possible", pa.list_(pa.string())), ("required", pa.list_(pa.string())), ("usable", pa.bool_())])),
    }

    def make():
        scan = scanner(allowed)

        def f(_, texts):
            rows = [scan(t) for t in texts]
            return {k: pa.array([r[k] for r in rows], kinds.get(k, pa.int64())) for k in _SCHEMA}

        return f

    return map_texts(docs, id_col, text_col, ", ".join(f"{k} {v}" for k, v in _SCHEMA.items()), make)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns: the tag expressions as evaluated, the labels that every one of their choices holds, and
    whether permissive licences satisfy all of them (null without expressions)."""
    out = scan_licenses(table(spark, sf_dir, "documents"))
    return out.selectExpr(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "array_join(base_labels, ',') base_labels", "array_join(labels, ',') labels", "score",
        "array_join(expressions.evaluated, '; ') expressions", "array_join(array_sort(array_distinct(flatten(expressions.required))), ',') required_labels",
        "if(size(expressions) = 0, null, forall(expressions, e -> e.usable)) usable",
    )
