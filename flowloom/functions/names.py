"""Column-name normalisation and likeness."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short forms met in field names, and words that carry no meaning in them.
SHORT = {
    "dst": "destination", "dest": "destination", "src": "source", "dur": "duration", "fwd": "forward", "bwd": "backward", "tot": "total",
    "pkt": "packet", "pkts": "packet", "packets": "packet", "hdr": "header", "len": "length", "byts": "byte", "bytes": "byte", "sec": "second", "secs": "second",
    "s": "second", "seconds": "second", "no": "number", "num": "number", "avg": "mean", "average": "mean", "std": "deviation", "init": "initial", "win": "window",
    "proto": "protocol", "ts": "timestamp", "ip": "address", "addr": "address", "cnt": "count", "dup": "copy", "1": "copy", "lbl": "label", "tag": "label",
}
EMPTY = {"of", "per", "the", "number", "rate"}
CONTEXT = {"b": ("byte", "copy"), "d": ("destination",)}  # at the front or middle, at the end


def normalize_name(name: str | None) -> str:
    """Lower snake case of letters and digits; null gives the empty name."""
    return re.sub(r"[^0-9a-zA-Z]+", "_", (name or "").strip().lower()).strip("_")


def normalized_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[^0-9a-z]+", "_"), "^_+|_+$", "")


@lru_cache(maxsize=65536)
def _split(word: str, known: frozenset[str]) -> tuple[str, ...]:
    """A word without separators as the fewest known words, else itself."""
    best: list[tuple[str, ...] | None] = [()] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            if best[start] is not None and word[start:end] in known and (best[end] is None or len(best[start]) + 1 < len(best[end])):
                best[end] = (*best[start], word[start:end])
    return best[-1] or (word,)


@lru_cache(maxsize=65536)
def name_words(name: str, fields: tuple[str, ...]) -> tuple[str, ...]:
    """The meaning words of a normalized name, short forms written out."""
    known = frozenset({w for f in fields for w in f.split("_")} | set(SHORT) | EMPTY | {"forward", "copy", "rate", "second"} | ({"d"} if len(name) <= 6 else set()))
    raw = [w for part in name.split("_") for w in (_split(re.sub(r"(.)\1\1+", r"\1", part), known) if part not in known else (part,))]
    words = []
    for i, w in enumerate(raw):
        if w in CONTEXT:
            w = CONTEXT[w][-1 if i == len(raw) - 1 else 0]
        words.append(SHORT.get(w, w))
    return tuple(w for w in words if w not in EMPTY) or tuple(words)


def _common(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def name_likeness(a: str, b: str, fields: tuple[str, ...]) -> float:
    """0 to 1: the words two names share, each pair of words by its longest common subsequence."""
    if a == b:
        return 1.0
    wa, wb = list(name_words(a, fields)), list(name_words(b, fields))
    pairs = sorted(((2 * _common(x, y) / (len(x) + len(y)) if x != y else 1.0, -abs(i - j), i, j) for i, x in enumerate(wa) for j, y in enumerate(wb)), reverse=True)
    used_a, used_b, total = set(), set(), 0.0
    for s, _, i, j in pairs:
        if i not in used_a and j not in used_b and s >= 0.6:
            used_a.add(i)
            used_b.add(j)
            total += s
    return 2 * total / (len(wa) + len(wb))
