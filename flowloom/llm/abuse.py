"""A score for abusive, hateful or sexually explicit language of each document, from a classifier chain.

Texts are folded first: words broken at line ends are joined, spaced-out, dotted and masked words recognised, signs
inside words dropped, and letters that scanners confuse mapped to one, so that misread words give the same features.
Letters of other scripts that only look like Latin ones are read as those within Latin words; words of other scripts
are spelt out in Latin letters, so they are features like any. Features are words and pairs of neighbours.

Chain: one linear (logistic) model per category in a fixed order, and a last one for any of them; each later model
also gets the probabilities of the earlier ones, out of fold while training. A document's score is the last link's
probability; the threshold is the one with the best F1 on out-of-fold scores. Known coarse words pull their weight towards a positive prior, so
that few labels do not leave the model blind; labels outweigh it. A document's fold is a hash of its folded text, so
copies of a page are never on both sides, and nothing depends on the order or number of partitions.

The model is fitted on at most `most_labelled` labelled documents (those of least hash of doc_id); their verdicts are
averaged over reviewers. Features are chosen among all of theirs by how surely they tell. Scoring reads whole texts in
one pass without a shuffle. Defined results: null, empty and blank texts score 0 and are never flagged; repeated rows get equal scores;
a document with as many verdicts for as against is left out of training; without labels the prior alone decides;
null sources are reported as null.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.runtime import stored

CATEGORIES = ("abusive", "hateful", "sexual")
MOST_LABELLED = 20_000
CONTRADICTED = 0.8
OFTEN = 0.006
FOLDS, STEPS, RIDGE, PRIOR, BIAS = 5, 150, 0.6, 2.5, -3.5
# Coarse words (en, de, fr, es) by the category they suggest.
COARSE = {
    "abusive": "cunt fuck fucking shit shithead arse arsehole bastard bitch prick whore bugger cretin imbecile maggot moron idiot scumbag hurensohn arschloch fotze wichser verrecke schwein drecksau miststück connard salaud salope enculé crève gueule putain merde cabrón puta pendejo gilipollas cállate mierda maldito pudras zorra",
    "hateful": "vermin subhuman ungeziefer untermenschen ersäufen sous-hommes vermine basura subhumanos exterminate",
    "sexual": "naked nude nipples thighs moaned bosomed unclothed lewd whores nackte geil weiber ficken titten nues chaudes baiser desnudas calientes follar tetas",
}
_BREAK = re.compile(r"[-\xad¬=][ \t]*\r?\n\s*")
_L = rb"a-z\xdf-\xf6\xf8-\xff"
_SPACED = re.compile(rb"\b[%b0-9] [%b0-9] (?:[%b0-9] )+[%b0-9]\b" % (_L, _L, _L, _L))
_MASK = re.compile(rb"([%b])[*#%%&]+([%b])(?![%b])" % (_L, _L, _L))
_DOTTED = re.compile(rb"(?<=[%b])[.](?=[%b]{2})" % (_L, _L))
_DIGIT = re.compile(rb"(?<=[%b])[01358$@]|[01358$@](?=[%b])" % (_L, _L))
_DIGITS = bytes.maketrans(b"01358$@", b"oiesbsa")
_WORD = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")
_SIGNS = bytes(c for c in (*range(0x20), *range(0x7F, 0xC0)) if c not in b" \t\n\r\f\v\x85\xa0\xa3\xab\xbb") + b"\\|~^`<>{}[]_\xd7\xf7"
_LOOKS = bytes.maketrans("eubfljqéèêáàâóòôöüúùûäíîïñßç".encode("latin-1"), b"cnhtiigcccaaaoooonnnnaiiinhc")


# Letters of other scripts that look like Latin ones, and Latin letters that don't decompose.
ALIKE = dict(zip("авекмнорстухіјѕԁԛԝһαικνορτυχɑɡ", "abekmhopctyxijsdqwhaikvoptuxag", strict=True))
PLAIN = {"ł": "l", "đ": "d", "ħ": "h", "ı": "i", "œ": "oe", "ŧ": "t", "ŋ": "n", "ə": "e"}
_FAR = re.compile(r"[^\W\d_]*[^\x00-\xff\W\d_][^\W\d_]*")
_SPELT = "aoxyzpsk"  # letters that folding leaves alone


def _near(word: str) -> str:
    """A word with letters beyond Western European ones in such letters: without their marks, by their looks, or spelt out."""
    out = []
    latin = any(c <= "\xff" or unicodedata.normalize("NFKD", c)[0] <= "z" for c in word)
    for c in word:
        base = unicodedata.normalize("NFKD", c)[0]
        if c <= "\xff":
            out.append(c)
        elif c in PLAIN or base <= "z":
            out.append(PLAIN.get(c, base))
        elif latin and c in ALIKE:
            out.append(ALIKE[c])
        else:
            n = ord(c)
            while n:
                out.append(_SPELT[n & 7])
                n >>= 3
    return "".join(out)


def _letters(text: str) -> bytes:
    """The text in one byte a letter; signs beyond are dropped."""
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return _FAR.sub(lambda m: _near(m[0]), text).encode("latin-1", "ignore")


def _look(b: bytes) -> bytes:
    return b.replace(b"rn", b"m").replace(b"vv", b"w").replace(b"cl", b"d").translate(_LOOKS)


def look(word: str) -> str:
    """A word with letters that scanners confuse mapped to one."""
    return _look(_letters(word)).decode("latin-1")


def words(text: str) -> list[str]:
    """Folded words in order."""
    b = _letters(unicodedata.normalize("NFKC", _BREAK.sub("", text)).lower().replace("—", "*")).translate(None, _SIGNS)
    b = _DIGIT.sub(lambda m: m[0].translate(_DIGITS), b)
    b = _SPACED.sub(lambda m: m[0].replace(b" ", b""), b)
    b = _MASK.sub(rb"\1qq\2", _DOTTED.sub(b"", b))
    return _WORD.findall(_look(b).decode("latin-1"))


def features(text: str | None) -> set[str]:
    if not text:
        return set()
    ws = words(text)
    return set(ws).union(map("%s %s".__mod__, zip(ws, ws[1:], strict=False)))


@dataclass
class Chain:
    """Feature numbers, weights by category (features, earlier categories, bias) and the threshold."""

    index: dict[str, int]
    weights: np.ndarray
    earlier: np.ndarray
    bias: np.ndarray
    threshold: float = 0.5

    def score(self, found: list[np.ndarray]) -> np.ndarray:
        """Probabilities (documents, categories)."""
        p = np.zeros((len(found), len(self.bias)))
        sizes = [len(f) for f in found]
        rows, cols = np.repeat(np.arange(len(found)), sizes), np.concatenate(found).astype(np.int64) if found else np.zeros(0, dtype=np.int64)
        for k in range(len(self.bias)):
            z = np.bincount(rows, self.weights[k][cols], minlength=len(found)) + self.bias[k] + p[:, :k] @ self.earlier[k][:k]
            p[:, k] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return p

    def numbers(self, text: str | None) -> np.ndarray:
        return np.fromiter((i for f in features(text) if (i := self.index.get(f)) is not None), dtype=np.int32)


def _fit(rows: np.ndarray, cols: np.ndarray, n: int, m: int, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression by full gradient steps (Adam); weights are pulled to the prior, extras to 0."""
    w, e, b = prior.copy(), np.zeros(extra.shape[1]), BIAS
    ms, vs = [0.0] * 3, [0.0] * 3
    for t in range(1, STEPS + 1):
        z = np.bincount(rows, w[cols], minlength=n) + extra @ e + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        grads = (np.bincount(cols, g[rows], minlength=m) + RIDGE * (w - prior), extra.T @ g + RIDGE * e, g.sum() + 0.01 * (b - BIAS))
        steps = []
        for i, gr in enumerate(grads):
            ms[i] = 0.9 * ms[i] + 0.1 * gr
            vs[i] = 0.99 * vs[i] + 0.01 * gr * gr
            steps.append(0.1 * (1 - t / (STEPS + 1)) * (ms[i] / (1 - 0.9**t)) / (np.sqrt(vs[i] / (1 - 0.99**t)) + 1e-8))
        w, e, b = w - steps[0], e - steps[1], b - steps[2]
    return w, e, float(b)


def _chain(found: list[np.ndarray], y: np.ndarray, weight: np.ndarray, index: dict[str, int], prior: np.ndarray, fold: np.ndarray) -> tuple[Chain, np.ndarray]:
    """The chain and the out-of-fold probabilities of its categories; fold: each document's, equal for equal texts."""
    n, m, k_all = len(found), len(index), y.shape[1]
    sizes = np.array([len(f) for f in found], dtype=np.int64)
    rows, cols = np.repeat(np.arange(n), sizes), np.concatenate(found).astype(np.int64) if n else np.zeros(0, dtype=np.int64)
    chain = Chain(index, np.zeros((k_all, m)), np.zeros((k_all, k_all)), np.full(k_all, BIAS))
    out = np.zeros((n, k_all))
    for k in range(k_all):
        for f in range(FOLDS) if n >= 2 * FOLDS else ():
            w, e, b = _fit(rows, cols, n, m, out[:, :k], y[:, k], weight * (fold != f), prior[k])
            z = np.bincount(rows, w[cols], minlength=n) + out[:, :k] @ e + b
            out[fold == f, k] = (1 / (1 + np.exp(-np.clip(z, -40, 40))))[fold == f]
        chain.weights[k], chain.earlier[k][:k], chain.bias[k] = _fit(rows, cols, n, m, out[:, :k], y[:, k], weight, prior[k])
    return chain, out


def train(found: list[np.ndarray], y: np.ndarray, weight: np.ndarray, index: dict[str, int], prior: np.ndarray, fold: np.ndarray) -> tuple[Chain, np.ndarray]:
    """The chain, and its out-of-fold score of each document; y (documents, categories and any).

    Verdicts that the out-of-fold score contradicts outright count little in a second fit.
    """
    chain, out = _chain(found, y, weight, index, prior, fold)
    truth = y.max(axis=1) > 0 if len(y) else np.zeros(0, dtype=bool)
    if truth.sum() < 20:
        return chain, out[:, -1]
    first = out[:, -1]
    weight = weight * np.where(np.abs(first - truth) > CONTRADICTED, 0.05, 1.0)
    chain, out = _chain(found, y, weight, index, prior, fold)
    any_out = out[:, -1]
    order = np.argsort(-any_out, kind="stable")
    hits, shown = np.cumsum((truth * weight)[order]), np.cumsum(weight[order])
    best = int(np.argmax(2 * hits / (shown + (truth * weight).sum())))
    chain.threshold = float(np.clip((any_out[order[best]] + any_out[order[min(best + 1, len(order) - 1)]]) / 2, 0.35, 0.8))
    return chain, any_out


def fit_chain(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> Chain:
    """Fits the chain on labelled documents; labels (doc_id, verdict, category)."""
    spark = docs.sparkSession
    share = [F.avg(F.when((F.col("verdict") == 1) & (F.col("category") == c), 1.0).otherwise(0.0)).alias(c) for c in CATEGORIES]
    votes = labels.where("doc_id IS NOT NULL AND verdict IS NOT NULL").groupBy("doc_id").agg(F.avg("verdict").alias("any"), F.count("*").alias("n"), *share).where("any <> 0.5")
    votes = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(votes), "doc_id")  # most_labelled rows at most
    texts = texts.groupBy("doc_id", "any", "n", *CATEGORIES).agg(F.min("text").alias("text"))

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ws = [words(t) for t in pdf["text"]]
            yield pdf.assign(fold=[zlib.crc32(" ".join(w).encode()) % FOLDS for w in ws], f=[sorted(features(t)) for t in pdf["text"]])[[*head, "f"]]

    types = {"doc_id": "bigint", "any": "double", "n": "bigint", **dict.fromkeys(CATEGORIES, "double"), "fold": "int"}
    head = list(types)
    schema = ", ".join(f"{c} {t}" for c, t in types.items())
    labelled = stored(texts.mapInPandas(explode, f"{schema}, f array<string>"))
    totals = labelled.agg(F.sum((F.col("any") > 0.5).cast("int")).alias("p"), F.count("*").alias("n")).first()
    base = ((totals["p"] or 0) + 0.5) / ((totals["n"] or 0) + 1)
    often = max(3, round(OFTEN * (totals["p"] or 0)))  # fewer cases are chance among so many features
    rate = (F.col("p") + base) / (F.col("d") + 1)
    counts = labelled.select((F.col("any") > 0.5).cast("int").alias("y"), F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("p"), F.count("*").alias("d"))
    counts = stored(counts.where(F.col("d") >= 3).select("f", "d", ((rate - 2.0 * F.sqrt(rate * (1 - rate) / (F.col("d") + 1)) > min(0.8, 1.5 * base)) & (F.col("p") >= often)).alias("strong")))
    coarse = {look(w): c for c, ws in COARSE.items() for w in ws.split()} | {w[0] + "qq" + w[-1]: c for c, ws in COARSE.items() if c == "abusive" for w in map(look, ws.split())}
    strong = {r["f"] for r in counts.where("strong").select("f").collect()} | set(coarse)  # of most_labelled documents
    known_words = spark.createDataFrame([(w,) for w in strong], "w string")
    pairs = counts.where(F.contains("f", F.lit(" ")) & (F.col("d") >= often))
    near = {r["f"] for r in pairs.select("f", F.explode(F.split("f", " ")).alias("w")).join(known_words, "w", "left_semi").select("f").distinct().collect()}  # the same
    index = {f: i for i, f in enumerate(sorted(strong | near))}
    prior = np.zeros((len(CATEGORIES) + 1, len(index)))
    for f, c in coarse.items():
        prior[[CATEGORIES.index(c), -1], index[f]] = PRIOR
    known = spark.sparkContext.broadcast(index)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns="f").assign(i=[[known.value[x] for x in f if x in known.value] for f in pdf["f"]])

    data = labelled.mapInPandas(number, f"{schema}, i array<int>").toPandas().sort_values("doc_id", ignore_index=True)  # most_labelled rows at most
    found = [np.asarray(i, dtype=np.int32) for i in data["i"]]
    agree = (data["any"] - 0.5).abs() * 2
    y = data[list(CATEGORIES)].to_numpy(dtype=float)
    y = np.where((data["any"] > 0.5).to_numpy()[:, None] & (y > 0), 1.0, 0.0)
    y = np.column_stack([y, (data["any"] > 0.5).to_numpy(dtype=float)])
    return train(found, y, (agree * np.sqrt(data["n"])).to_numpy(dtype=float), index, prior, data["fold"].to_numpy())[0]


def score_documents(docs: DataFrame, chain: Chain, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep, the probability of each category, score and flagged."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            p = c.score([c.numbers(t) for t in texts])
            p[[not (t and t.strip()) for t in texts]] = 0.0
            total = p[:, -1]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *[pa.array(p[:, k]) for k in range(len(CATEGORIES))], pa.array(total), pa.array(total >= c.threshold)], names=[*keep, *CATEGORIES, "score", "flagged"])

    schema = T.StructType([*[docs.schema[k] for k in keep], *[T.StructField(c, T.DoubleType()) for c in (*CATEGORIES, "score")], T.StructField("flagged", T.BooleanType())])
    return docs.select(*keep, text).mapInArrow(run, schema)


def rates(scored: DataFrame, source: str = "source") -> DataFrame:
    """Documents, flagged documents and their rate by source."""
    return scored.groupBy(source).agg(F.count("*").alias("n_documents"), F.count_if("flagged").alias("n_flagged"), F.round(F.avg(F.col("flagged").cast("double")), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))
