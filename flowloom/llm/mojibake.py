"""Text that was decoded with the wrong character encoding: found and restored.

A chain is one or two steps "written as A, read as B". For every text with characters beyond ASCII each chain that can
be undone gives a candidate; the text itself is one too. Expectation-maximization with the chain as latent variable:

* Likelihood: a model of neighbouring characters, counted over all texts that no chain fits (so are as written); its
  table has a fixed number of cells, whatever the data.
* Prior: how often each field of each source uses each chain, shrunk to the shares over all of them. The E step gives
  each text its posterior over chains, the M step sums them by source and field; these stay distributed rows. Rounds
  end when the shares of the chains settle.

Each record takes its most probable chain. Undoing a UTF-8 step works on the stretches that are valid UTF-8 as read
by B, so a text garbled in part is restored in part and the rest left as it was; single-byte steps apply to the whole.

`text_col` may be several columns, each a field of its own; then the rows have the field's name too. Defined results: null, empty and ASCII texts are never garbled; a text that holds U+FFFD has lost its bytes, its
restored text is empty; repeated rows get equal results within a source; texts of any length are handled whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.runtime import if_small, stored

CELLS = 1 << 16
MOST_ROUNDS, SETTLED = 50, 1e-3  # rounds end when less than this part of all records changes its chain
SHRINK = 20.0  # records a source's prior counts of the shares over all sources
AS_WRITTEN = "as_written"
# Encodings that texts are misread as, and single-byte pairs (written as, read as).
MISREAD_UTF8 = ("cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1251", "cp1250", "cp1253")
MISREAD_BYTES = (("cp1251", "cp1252"), ("cp1251", "latin-1"), ("cp1252", "latin-1"), ("cp1253", "cp1252"), ("cp1250", "cp1252"), ("koi8-r", "cp1251"), ("koi8-r", "cp1252"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp1251"))
SLOPPY = {"cp1252", "cp1251", "cp1250", "cp1253"}  # their undefined bytes are read as control characters


@lru_cache(maxsize=None)
def _to_byte(encoding: str) -> dict[str, int]:
    table = {}
    for b in range(256):
        try:
            table[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            if encoding in SLOPPY:
                table[chr(b)] = b
    return table


@lru_cache(maxsize=None)
def _utf8_pattern(encoding: str) -> re.Pattern:
    """Characters that, as bytes of the encoding, are one UTF-8 sequence of two to four bytes."""
    back = {b: c for c, b in _to_byte(encoding).items()}
    span = lambda a, z: "[" + "".join(re.escape(back[b]) for b in range(a, z + 1) if b in back) + "]"
    more = span(0x80, 0xBF)
    return re.compile(f"(?:{span(0xC2, 0xDF)}{more}|{span(0xE0, 0xEF)}{more}{{2}}|{span(0xF0, 0xF4)}{more}{{3}})")


def _undo_utf8(text: str, encoding: str) -> str:
    table = _to_byte(encoding)

    def one(m: re.Match) -> str:
        try:
            return bytes(table[c] for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    return _utf8_pattern(encoding).sub(one, text)


def _undo_bytes(text: str, written: str, read: str) -> str:
    table = _to_byte(read)
    if any(c not in table for c in text):
        return text
    raw = bytes(table[c] for c in text)
    try:
        return raw.decode(written)
    except UnicodeDecodeError:
        return text


STEPS = {f"utf-8>{e}": (lambda t, e=e: _undo_utf8(t, e)) for e in MISREAD_UTF8} | {f"{w}>{r}": (lambda t, w=w, r=r: _undo_bytes(t, w, r)) for w, r in MISREAD_BYTES}


def candidates(text: str) -> dict[str, str]:
    """Restored text by chain, the text itself under AS_WRITTEN; of chains with equal results the simplest stays."""
    out, seen = {AS_WRITTEN: text}, {text}
    first = []
    for name, undo in STEPS.items():
        if (t := undo(text)) not in seen:
            seen.add(t)
            out[name] = t
            first.append((name, t))
    for name, t in first:
        if not t.isascii():
            for again, undo in STEPS.items():
                if again.startswith("utf-8") or name.startswith("utf-8"):
                    if (u := undo(t)) not in seen:
                        seen.add(u)
                        out[f"{name}+{again}"] = u
    return out


def _kind(c: str) -> str:
    """Characters as the model sees them: ASCII letters by case, others themselves."""
    if "a" <= c <= "z":
        return "a"
    if "A" <= c <= "Z":
        return "A"
    return "0" if c.isascii() and c.isdigit() else c


def _cells(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the model's cells: of each character, and of each pair of neighbours that holds one beyond ASCII (pair, first, second)."""
    ks = ["^", *map(_kind, text), "$"]
    pairs = [(_hash(a + b), CELLS + _hash(a), CELLS + _hash(b)) for a, b in zip(ks, ks[1:], strict=False) if not (a.isascii() and b.isascii())]
    return np.array([CELLS + _hash(k) for k in ks], dtype=np.int64), np.array(pairs, dtype=np.int64).reshape(-1, 3)


@lru_cache(maxsize=1 << 18)
def _hash(s: str) -> int:
    h = 0
    for c in s:
        h = (h * 0x9E3779B1 + ord(c) * 0x85EBCA6B + 1) % 0x7FFFFFFF
    return h % CELLS


def _has_byte_signs(text: str) -> bool:
    return any(undo(text) != text for name, undo in STEPS.items() if name.startswith("utf-8")) or bool(re.search("[\x80-\x9f]", text))


def _score(text: str, table: np.ndarray) -> float:
    """Log likelihood of the pairs with a character beyond ASCII: half their own share, half that of their characters; a control costs extra."""
    ids = _cells(text)[1]
    if not len(ids):
        return 0.0
    pair, one = table[:CELLS], table[CELLS:]
    q = (one + 0.01) / (one.sum() + 0.01 * CELLS)
    own = pair[ids[:, 0]] / max(1.0, pair.sum())
    controls = sum("\x80" <= c <= "\x9f" for c in text)
    return float(np.log(0.5 * own + 0.5 * q[ids[:, 1] - CELLS] * q[ids[:, 2] - CELLS]).sum()) - 12.0 * controls


def find_garbled(df: DataFrame, id_col: str, text_col: str | list[str], source_col: str, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(id_col, chain, restored), with several text columns (id_col, field, chain, restored): one row per text that is garbled."""
    spark = df.sparkSession
    fields = [text_col] if isinstance(text_col, str) else text_col
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in fields]))
    rows = df.select(F.col(id_col), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__source"), each.alias("__x")).select(id_col, "__source", F.col("__x.field").alias("__field"), F.col("__x.text").alias("__text")).where(F.col("__text").rlike(r"[^\x00-\x7F]"))
    lost = rows.where(F.contains("__text", F.lit("�"))).select(id_col, F.col("__field").alias("field"), F.lit("lost").alias("chain"), F.lit("").alias("restored"))
    texts = stored(rows.where(~F.contains("__text", F.lit("�"))).groupBy("__source", "__field", "__text").agg(F.count("*").alias("n")))

    def clean_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = np.zeros(2 * CELLS, dtype=np.int64)
        for pdf in batches:
            for text, n in zip(pdf["__text"], pdf["n"], strict=True):
                if not _has_byte_signs(text):
                    one, pairs = _cells(text)
                    np.add.at(count, one, n)
                    np.add.at(count, pairs[:, 0], n)
        at = np.flatnonzero(count)
        yield pd.DataFrame({"cell": at, "n": count[at]})

    table = np.zeros(2 * CELLS)
    for r in texts.select("__text", "n").mapInPandas(clean_cells, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most 2 * CELLS rows
        table[r["cell"]] = r["n"]
    model = spark.sparkContext.broadcast(table)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for source, field, text, n in pdf[["__source", "__field", "__text", "n"]].itertuples(index=False, name=None):
                found = candidates(text)
                if len(found) > 1:
                    out.append((source, field, text, n, list(found), list(found.values()), [_score(t, model.value) for t in found.values()]))
            yield pd.DataFrame(out, columns=["source", "field", "text", "n", "chains", "texts", "loglik"])

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work: not to be put together
    options = stored(texts.repartition(tasks, "__text").mapInPandas(score, "source string, field string, text string, n bigint, chains array<string>, texts array<string>, loglik array<double>"))
    own = ["source", "field"]

    def weighed(prior: DataFrame | None) -> DataFrame:
        """options with `__l`: log likelihood plus prior of each chain, as many as there are chains."""
        if prior is None:
            return options.withColumn("__l", F.transform("chains", lambda c: F.when(c == AS_WRITTEN, 0.0).otherwise(-2.0))).withColumn("__l", F.zip_with("loglik", "__l", lambda a, b: a + b))
        by = prior.groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("chain", "logprior"))).alias("__prior"))  # one row a field and source
        return options.join(if_small(by), own, "left").withColumn("__l", F.zip_with("loglik", F.transform("chains", lambda c: F.coalesce(F.try_element_at("__prior", c), F.lit(-12.0))), lambda a, b: a + b)).drop("__prior")

    prior, before = None, None
    for _ in range(most_rounds):
        e = weighed(prior).withColumn("__e", F.transform("__l", lambda x: F.exp(x - F.array_max("__l"))))
        part = e.withColumn("__z", F.aggregate("__e", F.lit(0.0), lambda a, x: a + x)).select(*own, "n", "__z", F.explode(F.arrays_zip("chains", "__e")).alias("x"))
        share = stored(part.groupBy(*own, F.col("x.chains").alias("chain")).agg(F.sum(F.col("n") * F.col("x.__e") / F.col("__z")).alias("r")))
        every = {r["chain"]: r["r"] for r in share.groupBy("chain").agg(F.sum("r").alias("r")).collect()}  # one row a chain
        whole = sum(every.values())
        total = share.groupBy(*own).agg(F.sum("r").alias("r_own"))
        overall = F.element_at(F.create_map(*[F.lit(x) for kv in every.items() for x in kv]), F.col("chain")) if every else F.lit(0.0)
        prior = share.join(if_small(total), own).select(*own, "chain", F.log((F.col("r") + SHRINK * (overall + 1e-4) / (whole + 1e-9)) / (F.col("r_own") + SHRINK)).alias("logprior"))
        moved = sum(abs(every.get(c, 0.0) - (before or {}).get(c, 0.0)) for c in {*every, *(before or {})})
        if before is not None and moved <= SETTLED * whole:
            break
        before = every
    best = weighed(prior).select(*own, "text", F.array_max(F.transform(F.arrays_zip("__l", "chains", "texts"), lambda x: F.struct(x["__l"], x["chains"], x["texts"]))).alias("b"))
    garbled = best.where(F.col("b.chains") != AS_WRITTEN).select(F.col("source").alias("__s"), F.col("field").alias("__f"), F.col("text").alias("__t"), F.col("b.chains").alias("chain"), F.col("b.texts").alias("restored"))
    back = rows.join(garbled, (F.col("__source") == F.col("__s")) & (F.col("__field") == F.col("__f")) & (F.col("__text") == F.col("__t"))).select(id_col, F.col("__field").alias("field"), "chain", "restored")
    out = back.unionByName(lost)
    return out.drop("field") if isinstance(text_col, str) else out


def plausible(text: str) -> str:
    """A single text restored without statistics: UTF-8 steps that fit are undone, as often as they fit."""
    for _ in range(2):
        fits = [t for name, undo in STEPS.items() if name.startswith("utf-8") and (t := undo(text)) != text]
        if not fits:
            break
        text = min(fits, key=lambda t: (len(t), sum(ord(c) > 0x2FFF for c in t)))
    return text
