"""Byte-level BPE with a public tokenizer's vocabulary, written here.

A text is cut into words by the vocabulary's pattern; each distinct word is merged once per worker by a priority
queue of merge ranks over a doubly linked symbol list (entries whose pair has changed are skipped when popped), and
its ids are kept in a dictionary of bounded size. Special tokens' strings in a text are ordinary text.

Defined results: an empty and a null text have no ids (an empty list, never null); texts of any length are encoded
whole; each row is encoded by itself, so repeated rows have equal ids.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOCABULARIES = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
WIDTH = array("i").itemsize
WORDS_KEPT = 400_000  # entries a worker keeps; when full the dictionary starts anew
LONG_WORD = 256  # longer words aren't kept
# Fixed value: the pattern that cuts texts for this vocabulary, white space as Unicode defines it.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def merge(symbols: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: always the lowest-ranked adjacent pair is joined, the leftmost first."""
    if (whole := ranks.get(symbols)) is not None:
        return [whole]
    n = len(symbols)
    piece: list[bytes | None] = [symbols[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(r, i, symbols[i : i + 2]) for i in range(n - 1) if (r := ranks.get(symbols[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, pair = heapq.heappop(queue)
        left = piece[i]
        if left is None or (j := after[i]) >= n or len(left) + len(piece[j]) != len(pair) or left + piece[j] != pair:
            continue  # stale: one side has been joined since
        piece[i], piece[j] = pair, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(joined := pair + piece[k])) is not None:
                heapq.heappush(queue, (r, i, joined))
        if (h := before[i]) >= 0 and (r := ranks.get(joined := piece[h] + pair)) is not None:
            heapq.heappush(queue, (r, h, joined))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i]])
        i = after[i]
    return out


class _Words(dict):
    """Ids of words as bytes of 32-bit integers, so that those of a text are joined without a loop."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> bytes:
        ids = array("i", merge(word.encode("utf-8", "replace"), self.ranks)).tobytes()
        if len(word) <= LONG_WORD:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    def __init__(self, vocabulary: str):
        lines = (line.split() for line in Path(vocabulary).read_bytes().splitlines() if line)
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.strings = {v: k for k, v in self.ranks.items()}
        self.words = _Words(self.ranks)
        self.cut = regex.compile(PATTERN).findall

    def packed(self, text: str | None) -> bytes:
        return b"".join(map(self.words.__getitem__, self.cut(text))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def count(self, text: str | None) -> int:
        return len(self.packed(text)) // WIDTH

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def vocabulary_path(folder: str = VOCABULARIES, name: str = VOCABULARY) -> str:
    return f"{folder}/{name}"


def encode_column(df: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None, out: str = "ids") -> DataFrame:
    """(id_col, out): the token ids of each row's text; one pass without a shuffle."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            packed = [enc.packed(text) for text in b.column(1).to_pylist()]
            offsets = np.cumsum([0, *map(len, packed)], dtype=np.int64) // WIDTH
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(packed), dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[id_col, out])

    schema = T.StructType([df.schema[id_col], T.StructField(out, T.ArrayType(T.IntegerType(), True), True)])
    return df.select(id_col, text_col).mapInArrow(run, schema)


def count_tokens(df: DataFrame, keep: list[str], text_col: str, vocabulary: str | None = None, out: str = "n_tokens") -> DataFrame:
    """df's columns `keep` and the number of tokens of each text."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = pa.array([enc.count(t) for t in b.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], n], names=[*keep, out])

    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(out, T.LongType(), True)])
    return df.select(*keep, text_col).mapInArrow(run, schema)


def decode_column(df: DataFrame, id_col: str, ids_col: str, vocabulary: str | None = None, out: str = "text") -> DataFrame:
    """(id_col, out): the texts behind lists of ids; null ids give the empty text."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], names=[id_col, out])

    schema = T.StructType([df.schema[id_col], T.StructField(out, T.StringType(), True)])
    return df.select(id_col, ids_col).mapInArrow(run, schema)
