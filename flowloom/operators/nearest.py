"""How many of a row's nearest neighbours in a whole table share its class, exactly and in tasks of bounded size.

The table is cut into boxes of about `cell` different rows (a k-d tree of a sample); a query searches its own box first,
then only the boxes that are no farther than the neighbours it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.runtime import stored

CELL, SAMPLED, MOST_SAMPLED, QUERIES, AT_ONCE = 4096, 32, 50_000, 8192, 2_000_000


def _tree(x: np.ndarray, least: int, cells: list[int]):
    """(feature, threshold, left, right), or a cell's number; the widest feature that splits rows about evenly."""
    best = None
    if len(x) > least:
        for j in np.argsort(-x.std(axis=0), kind="stable"):
            t = np.median(x[:, j])
            if t == x[:, j].max():
                below = x[:, j][x[:, j] < t]
                if not len(below):
                    continue
                t = below.max()
            left = x[:, j] <= t
            even = min(left.mean(), 1 - left.mean())
            if best is None or even > best[0]:
                best = (even, int(j), float(t), left)
            if even >= 0.25:
                break
    if best is None:
        cells.append(len(cells))
        return cells[-1]
    _, j, t, left = best
    return j, t, _tree(x[left], least, cells), _tree(x[~left], least, cells)


def _cells(x: np.ndarray, tree) -> np.ndarray:
    out, todo = np.zeros(len(x), dtype=np.int64), [(np.arange(len(x)), tree)]
    while todo:
        at, node = todo.pop()
        if isinstance(node, int):
            out[at] = node
        else:
            left = x[at, node[0]] <= node[1]
            todo += [(at[left], node[2]), (at[~left], node[3])]
    return out


def _placed(df: DataFrame, features: list[str], tree) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(__cell=_cells(pdf[features].to_numpy(dtype=float), tree))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", `__cell` bigint"
    return df.mapInPandas(run, schema)


def _squares(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    out = np.zeros((len(q), len(p)))
    for j in range(q.shape[1]):
        d = q[:, j, None] - p[None, :, j]
        out += d * d
    return out


def _best(q: np.ndarray, p: np.ndarray, m: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance and number of the `want` nearest of p, padded with rows of number 0."""
    dist, number = np.full((len(q), want), np.inf), np.zeros((len(q), want), dtype=np.int64)
    if len(p):
        d, w = _squares(q, p), min(want, len(p))
        at = np.argpartition(d, w - 1, axis=1)[:, :w]
        dist[:, :w], number[:, :w] = np.take_along_axis(d, at, axis=1), m[at]
    return dist, number


def _search(features: list[str], want: int):
    """(__id, d, other, farthest): the `want` nearest rows of a box to each query; at equal distance, its own class first."""

    def run(queries: pd.DataFrame, pool: pd.DataFrame) -> pd.DataFrame:
        x, p, m = queries[features].to_numpy(dtype=float), pool[features].to_numpy(dtype=float), pool["__m"].to_numpy()
        labels, owner, ids, out = pool["label"].to_numpy(), queries["label"].to_numpy(), queries["__id"].to_numpy(), []
        step = max(1, AT_ONCE // max(1, len(p)))
        for c in pd.unique(owner):
            mine, at = labels == c, np.flatnonzero(owner == c)
            for i in range(0, len(at), step):
                q = x[at[i : i + step]]
                (d0, m0), (d1, m1) = _best(q, p[mine], m[mine], want), _best(q, p[~mine], m[~mine], want)
                d, n = np.hstack([d0, d1]), np.hstack([m0, m1])
                order = np.argsort(d, axis=1, kind="stable")
                d, n, other = np.take_along_axis(d, order, axis=1), np.take_along_axis(n, order, axis=1), (order >= want).astype(int)
                take = np.clip(want - (np.cumsum(n, axis=1) - n), 0, n)
                far = np.where(take.sum(axis=1) == want, np.where(take > 0, d, -np.inf).max(axis=1), np.inf)
                times = take.ravel()
                out.append(pd.DataFrame({"__id": np.repeat(np.repeat(ids[at[i : i + step]], d.shape[1]), times), "d": np.repeat(d.ravel(), times), "other": np.repeat(other.ravel(), times), "farthest": np.repeat(np.repeat(far, d.shape[1]), times)}))
        return pd.concat(out) if out else pd.DataFrame({"__id": [], "d": [], "other": [], "farthest": []})

    return run


def _reached(features: list[str], boxes: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """(query, box) for each other box that is within the query's farthest neighbour so far."""
    number, lo, hi = boxes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            step = max(1, AT_ONCE // max(1, len(number)))
            for i in range(0, len(pdf), step):
                part = pdf.iloc[i : i + step]
                x, d = part[features].to_numpy(dtype=float), np.zeros((len(part), len(number)))
                for j in range(len(features)):
                    off = np.maximum(np.maximum(lo[None, :, j] - x[:, j, None], x[:, j, None] - hi[None, :, j]), 0)
                    d += off * off
                row, box = np.nonzero((d <= part["farthest"].to_numpy()[:, None]) & (part["__cell"].to_numpy()[:, None] != number[None, :]))
                yield part.iloc[row].drop(columns=["farthest"]).assign(__cell=number[box])

    return run


def own_class_share(queries: DataFrame, pool: DataFrame, features: list[str], k: int, cell: int = CELL) -> DataFrame:
    """(__id, share): the share of a query's own class among its k nearest rows of the whole pool.

    queries (__id, label, features), pool (label, features), both read more than once. Rows without a number in each
    feature have no distance and are left out. Equal rows of a class are one row with a number, so no box is full of them.
    """
    full = lambda df: df.where(F.forall(F.array(*[F.col(f) for f in features]), lambda v: v.isNotNull() & ~F.isnan(v)))
    once = stored(full(pool).groupBy(*features, "label").agg(F.least(F.count("*"), F.lit(k)).alias("__m")))
    n = once.count()
    cells = -(-n // cell)
    want = min(MOST_SAMPLED, SAMPLED * cells)
    seen = once if n <= want else once.where(F.pmod(F.xxhash64(*features, "label"), F.lit(n)) < want)
    x = seen.select(*features).toPandas().to_numpy(dtype=float) if cells > 1 else np.zeros((0, len(features)))  # MOST_SAMPLED rows, about
    tree = _tree(x, max(1, len(x) // max(1, cells)), [])
    placed = stored(_placed(once, features, tree))
    ends = placed.groupBy("__cell").agg(*[F.min(f).alias(f"lo{i}") for i, f in enumerate(features)], *[F.max(f).alias(f"hi{i}") for i, f in enumerate(features)]).collect()  # one row a box
    boxes = tuple(np.array([[r[f"{s}{i}"] for i in range(len(features))] for r in ends], dtype=float).reshape(len(ends), len(features)) for s in ("lo", "hi"))
    asked = stored(_placed(full(queries).select("__id", "label", *features), features, tree))
    found = "__id bigint, d double, other int, farthest double"

    def search(q: DataFrame) -> DataFrame:
        """Many queries of one box are several tasks, each with the box's rows."""
        times = F.broadcast(q.groupBy("__cell").agg(F.ceil(F.count("*") / F.lit(QUERIES)).cast("int").alias("__times")))  # one row a box
        some = q.join(times, "__cell").withColumn("__part", F.pmod(F.xxhash64("__id"), F.col("__times")).cast("int")).drop("__times")
        rows = placed.join(times, "__cell").withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__times") - 1))).drop("__times")
        return some.groupBy("__cell", "__part").cogroup(rows.groupBy("__cell", "__part")).applyInPandas(_search(features, k), found)

    first = stored(search(asked))
    radius = first.groupBy("__id").agg(F.min("farthest").alias("farthest"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema)
    more = asked.join(radius, "__id", "left").withColumn("farthest", F.coalesce("farthest", F.lit(float("inf"))))
    visits = stored(more.select(*asked.columns, "farthest").mapInPandas(_reached(features, (np.array([r["__cell"] for r in ends], dtype=np.int64), *boxes)), schema))
    near = first.unionByName(search(visits)) if len(ends) > 1 else first
    nearest = near.groupBy("__id").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "other"))), 1, k).alias("near"))
    return nearest.select("__id", (F.size(F.filter("near", lambda v: v["other"] == 0)) / F.size("near")).alias("share"))
