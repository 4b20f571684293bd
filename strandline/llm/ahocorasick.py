"""Aho-Corasick over whole words: phrases are matched in text reduced to single-spaced words."""

from __future__ import annotations

import ahocorasick

_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes(0x20 if b in _SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def spaced_words(text: str) -> str:
    """' w1 w2 ... wn ' of the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z; ' ' if there are none."""
    words = text.encode("utf-8", "replace").translate(_TABLE).split()
    return (b" " + b" ".join(words) + b" ").decode() if words else " "


def word_automaton(phrases: dict[str, object]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, value in phrases.items():
        a.add_word(f" {phrase} ", (value, phrase))
    a.make_automaton()
    return a
