"""Fields that are added, removed, renamed or retyped between the files of a series, and one table of all files.

Every file is profiled by position in one aggregate that combines before its shuffle (a file or series with a third
of all lines costs no more than its columns): number of cells that are whole numbers, numbers, empty; moments of the
logarithm of their value (units, hexadecimal and service names read as numbers); a minhash sketch of the cells.
Files equal in names and types to the one before are dropped; the others stream in order, with one profile per field
in memory. Fields of equal name match; the rest are matched by an optimal assignment over name and value likeness.
Where names share nothing, type, sketch and distribution can carry a match alone, given LEAST_CELLS cells on both sides.
A field keeps its identity along its renames, so each change is reported under the field's first known name.

Defined results: of headers equal after normalization the first counts; cells beyond the header are ignored, missing
ones are empty; a file without cells in a field keeps the field's last type; files without header line and null lines
are ignored; the file before is the last one with a smaller number; an empty table gives no change.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.names import name_likeness, normalized_name
from flowloom.runtime import stored

SKETCH = 16
RENAME_AT, NAME_AT, FIELD_AT = 0.5, 0.4, 0.8
VALUES_AT, LEAST_CELLS = 0.7, 30  # without any likeness of names: the evidence asked for, and the cells below which values can't give it
# Ports of service names met in place of numbers, and unit factors.
SERVICES = {"ftp": 21, "ssh": 22, "telnet": 23, "smtp": 25, "domain": 53, "dns": 53, "http": 80, "https": 443, "http-alt": 8080, "mysql": 3306, "rdp": 3389, "ms-wbt-server": 3389, "postgresql": 5432, "ms-sql-s": 1433}
UNITS = {"b": 1.0, "kb": 1e3, "mb": 1e6, "gb": 1e9}


def split_line(line: Column) -> Column:
    """The cells of a comma-separated line; quotes may hold commas and doubled quotes."""
    plain = F.split(line, ",", -1)
    quoted = F.transform(F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1), lambda x: F.when(F.trim(x).rlike(r'^".*"$'), F.regexp_replace(F.regexp_replace(F.trim(x), r'^"|"$', ""), '""', '"')).otherwise(x))
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(plain)


def _value(cell: Column) -> Column:
    """A number behind a cell, whatever its notation."""
    low = F.lower(cell)
    unit = F.regexp_extract(low, r"^-?[0-9.]+ ?([kmg]?b)$", 1)
    return F.coalesce(
        cell.try_cast("double"),
        F.when(low.rlike("^0x[0-9a-f]{1,15}$"), F.conv(F.substring(low, 3, 20), 16, 10).cast("double")),
        F.when(unit != "", F.regexp_extract(low, r"^(-?[0-9.]+)", 1).try_cast("double") * F.element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), unit)),
        F.element_at(F.create_map(*[F.lit(x) for k, v in SERVICES.items() for x in (k, float(v))]), low),
    )


def file_profiles(lines: DataFrame, series: str, file_no: str, line_no: str, line: str) -> DataFrame:
    """One row for each series, file and field: name, type, moments and sketch. One scan, one shuffle of partial aggregates."""
    cells = lines.where(F.col(line).isNotNull()).select(F.col(series).alias("series"), F.col(file_no).cast("bigint").alias("file_no"), (F.col(line_no) == 0).alias("head"), F.posexplode(split_line(F.col(line))).alias("pos", "raw"))
    cell = F.trim(F.regexp_replace("raw", r"[\r\n\t ]+", " "))
    body = cells.withColumn("cell", F.when(~F.col("head"), F.nullif(cell, F.lit("")))).withColumn("v", _value(F.col("cell"))).withColumn("hash", F.xxhash64("cell"))
    size = F.log1p(F.abs(F.when(F.abs("v") < F.lit(float("inf")), F.col("v"))))
    part = F.col("cell").isNotNull()
    profile = body.groupBy("series", "file_no", "pos").agg(
        F.min(F.when(F.col("head"), F.col("raw"))).alias("raw"),
        F.count("cell").alias("n"),
        F.count_if(F.col("cell").rlike("^-?[0-9]+$")).alias("n_whole"),
        F.count_if(F.col("cell").rlike(r"^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$")).alias("n_number"),
        F.count(size).alias("n_value"), F.coalesce(F.avg(size), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop(size), F.lit(0.0)).alias("spread"),
        F.coalesce(F.avg((F.col("v") <= 0).cast("double")), F.lit(0.0)).alias("low"),
        *[F.min(F.when(part & (F.pmod("hash", F.lit(SKETCH)) == i), F.col("hash"))).alias(f"h{i}") for i in range(SKETCH)],
    )
    kind = F.when(F.col("n") == 0, F.lit("")).when(F.col("n_whole") == F.col("n"), "long").when(F.col("n_number") == F.col("n"), "double").otherwise("string")
    named = profile.withColumn("name", normalized_name(F.col("raw"))).where("raw IS NOT NULL AND name <> ''")
    whole = named.select("series", "file_no", "name", "pos", kind.alias("kind"), "n", "n_value", "mean", "spread", "low", F.array(*[F.coalesce(f"h{i}", F.lit(0)) for i in range(SKETCH)]).alias("sketch"))
    once = whole.groupBy("series", "file_no", "name").agg(F.min_by(F.struct("pos", "kind", "n", "n_value", "mean", "spread", "low", "sketch"), "pos").alias("p"))
    return once.select("series", "file_no", "name", "p.*")


def shared_values(a: dict, b: dict) -> float:
    """Share of the different cells two columns have in common, estimated from their sketches (one minimum a hash class)."""
    both = [(x, y) for x, y in zip(a["sketch"], b["sketch"], strict=True) if x or y]  # 0: no cell of this class
    return sum(x == y for x, y in both) / len(both) if both else 0.0


def _value_likeness(a: dict, b: dict) -> float:
    if bool(a["n_value"]) != bool(b["n_value"]):
        return 0.0
    if not a["n_value"]:
        return max(0.3, shared_values(a, b))
    apart = abs(a["mean"] - b["mean"]) / (0.5 + (a["spread"] + b["spread"]) / 2)
    return math.exp(-apart)


def value_evidence(a: dict, b: dict) -> float:
    """How surely two columns hold the same field, judged by type, sketch and distribution alone; 0 to 1."""
    if not a["n"] or not b["n"] or a["kind"] != b["kind"] or bool(a["n_value"]) != bool(b["n_value"]):
        return 0.0
    shared = shared_values(a, b)
    if not a["n_value"]:
        return shared
    spread = 0.05 + (a["spread"] + b["spread"]) / 2
    few = math.sqrt(1 / a["n_value"] + 1 / b["n_value"])
    apart = max(0.0, abs(a["mean"] - b["mean"]) / spread - few)
    wider = max(0.0, abs(math.log((0.05 + a["spread"]) / (0.05 + b["spread"]))) - few)
    return max(math.exp(-apart - wider - 2 * max(0.0, abs(a["low"] - b["low"]) - few / 2)), shared)


def assign(gain: list[list[float]], least: float) -> list[tuple[int, int]]:
    """The pairs (row, column) of greatest total gain, each row and column once, pairs under `least` left out."""
    n, m = len(gain), len(gain[0]) if gain else 0
    if not n or not m:
        return []
    if n > m:
        return [(i, j) for j, i in assign([list(c) for c in zip(*gain, strict=True)], least)]
    worth = [[g if g >= least else 0.0 for g in row] for row in gain]
    u, v, match, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):  # shortest augmenting paths
        match[0], j0, low, seen = i, 0, [math.inf] * (m + 1), [False] * (m + 1)
        while match[j0]:
            seen[j0], i0, delta, j1 = True, match[j0], math.inf, 0
            for j in range(1, m + 1):
                if not seen[j]:
                    cost = -worth[i0 - 1][j - 1] - u[i0] - v[j]
                    if cost < low[j]:
                        low[j], way[j] = cost, j0
                    if low[j] < delta:
                        delta, j1 = low[j], j
            for j in range(m + 1):
                if seen[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    low[j] -= delta
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j] and worth[match[j] - 1][j - 1] > 0]


class _Series:
    """The fields of a series as of its last file."""

    def __init__(self, fields: tuple[str, ...]):
        self.fields, self.live = fields, None

    def _field(self, names: list[str], taken: set[str]) -> dict[str, str]:
        """Field of each new name: itself if a known one, else the known field not in the file whose name is nearly the same."""
        free = [f for f in self.fields if f not in taken and f not in names]
        odd = [n for n in names if n not in self.fields]
        found = {n: n for n in names}
        gain = [[name_likeness(n, f, self.fields) for f in free] for n in odd]
        keep = [j for j in range(len(free)) if any(row[j] >= FIELD_AT for row in gain)]
        for i, j in assign([[row[j] for j in keep] for row in gain], FIELD_AT) if keep else []:
            found[odd[i]] = free[keep[j]]
        return found

    def _by_values(self, a: dict, b: dict, name: str) -> float:
        """Gain of a rename that only values speak for: none if there are few cells or the new name is that of another field."""
        if min(a["n"], b["n"]) < LEAST_CELLS or any(name_likeness(name, f, self.fields) >= FIELD_AT for f in self.fields if f != a["field"]):
            return 0.0
        evidence = value_evidence(a, b)
        return RENAME_AT + (evidence - VALUES_AT) if evidence >= VALUES_AT else 0.0

    def next(self, file: dict[str, dict]) -> list[tuple[str, str]]:
        if self.live is None:
            ids = self._field(list(file), set())
            self.live = {n: p | {"field": ids[n]} for n, p in file.items()}
            return []
        old, out, now = self.live, [], {}
        gone, new = [n for n in old if n not in file], [n for n in file if n not in old]
        gain = []
        for a in gone:
            row = []
            for b in new:
                likes = max(name_likeness(a, b, self.fields), name_likeness(old[a]["field"], b, self.fields))
                s = 0.75 * likes + 0.25 * _value_likeness(old[a], file[b])
                row.append(s if likes >= NAME_AT else self._by_values(old[a], file[b], b))
            gain.append(row)
        renamed = {new[j]: gone[i] for i, j in assign(gain, RENAME_AT)}
        came = [n for n in new if n not in renamed]
        ids = self._field(came, {old[a]["field"] for a in old})
        for n, p in file.items():
            before = old.get(n) or (old[renamed[n]] if n in renamed else None)
            field = before["field"] if before else ids[n]
            if n in renamed:
                out.append((field, "renamed"))
            if before is None:
                out.append((field, "added"))
            elif p["kind"] and before["kind"] and p["kind"] != before["kind"]:
                out.append((field, "retyped"))
            now[n] = p | {"field": field, "kind": p["kind"] or (before["kind"] if before else "")}
        out += [(old[n]["field"], "removed") for n in gone if n not in renamed.values()]
        self.live = now
        return out


def _walk(fields: tuple[str, ...], names: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, file = (None, None), None, {}

        def close() -> list[tuple]:
            changes = state.next(file)
            if names:
                return [(at[0], at[1], n, p["field"], p["pos"]) for n, p in state.live.items()]
            return [(at[0], at[1], f, k) for f, k in changes]

        columns = ["series", "file_no", "name", "field_name", "pos"] if names else ["series", "file_no", "field_name", "change_kind"]
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                if (r["series"], r["file_no"]) != at:
                    if file:
                        out += close()
                    if r["series"] != at[0]:
                        state = _Series(fields)
                    at, file = (r["series"], r["file_no"]), {}
                file[r["name"]] = {k: r[k] for k in ("kind", "n", "n_value", "mean", "spread", "low", "sketch", "pos")}
            yield pd.DataFrame(out, columns=columns)
        if file:
            yield pd.DataFrame(close(), columns=columns)

    return run


def _ordered(profiles: DataFrame) -> DataFrame:
    return profiles.where("series IS NOT NULL").repartition("series").sortWithinPartitions("series", "file_no", "pos")


def schema_changes(lines: DataFrame, fields: list[str], series: str = "series", file_no: str = "file_no", line_no: str = "line_no", line: str = "raw_line") -> DataFrame:
    """(series, file_no, field_name, change_kind): one row for each change from the file before."""
    profiles = stored(file_profiles(lines, series, file_no, line_no, line))
    marks = F.sort_array(F.collect_list(F.struct("name", "kind")))  # the columns of one file
    sign = profiles.groupBy("series", "file_no").agg(F.struct(F.xxhash64(marks), F.xxhash64(F.lit(7), marks)).alias("sign"))
    along = Window.partitionBy("series").orderBy("file_no")
    same_before, same_after = F.col("sign") == F.lag("sign").over(along), F.col("sign") == F.lead("sign").over(along)
    needed = sign.withColumn("__b", F.coalesce(same_before, F.lit(False))).withColumn("__a", F.coalesce(same_after, F.lit(False))).where("NOT (__b AND __a)").select("series", "file_no")
    return _ordered(profiles.join(needed, ["series", "file_no"])).mapInPandas(_walk(tuple(fields), False), "series string, file_no bigint, field_name string, change_kind string")


def field_names(lines: DataFrame, fields: list[str], series: str = "series", file_no: str = "file_no", line_no: str = "line_no", line: str = "raw_line") -> DataFrame:
    """(series, file_no, name, field_name, pos): which field each column of each file holds."""
    return _ordered(file_profiles(lines, series, file_no, line_no, line)).mapInPandas(_walk(tuple(fields), True), "series string, file_no bigint, name string, field_name string, pos int")


def unify(lines: DataFrame, types: dict[str, str], series: str = "series", file_no: str = "file_no", line_no: str = "line_no", line: str = "raw_line") -> DataFrame:
    """One table of all body lines under the given fields (types: Spark type by field), other fields in the map `extra`.

    Numbers are read through units, hexadecimal and service names; a cell that is none gives null.
    """
    names = field_names(lines, list(types), series, file_no, line_no, line)
    heads = names.groupBy("series", "file_no").agg(F.map_from_entries(F.collect_list(F.struct("pos", "field_name"))).alias("__fields"))
    body = lines.where((F.col(line_no) > 0) & F.col(line).isNotNull()).select(F.col(series).alias("series"), F.col(file_no).cast("bigint").alias("file_no"), F.col(line_no).alias("line_no"), split_line(F.col(line)).alias("__cells"))
    rows = body.join(heads, ["series", "file_no"])
    entries = F.filter(F.transform("__cells", lambda x, i: F.struct(F.col("__fields")[i].alias("key"), F.nullif(F.trim(x), F.lit("")).alias("value"))), lambda e: e["key"].isNotNull())
    rows = rows.withColumn("__row", F.map_from_entries(entries))
    number = lambda c, t: (F.when(F.abs(_value(c)) < 9e18, F.round(_value(c))).cast("bigint") if t == "bigint" else _value(c))
    cols = [(F.col("__row")[f] if t == "string" else number(F.col("__row")[f], t)).alias(f) for f, t in types.items()]
    return rows.select("series", "file_no", "line_no", *cols, F.map_filter("__row", lambda k, v: ~k.isin(*types)).alias("extra"))
