"""Mixed timestamp notations and zones to one UTC instant.

Every text is reduced (in the JVM) to its character-class mask: each digit to 9, each letter to a. A mask fixes where
every part of its texts stands, so each distinct mask is mapped to a parser once per worker, and the parser converts
all texts of the mask in an Arrow batch by slicing fixed columns of one character array. Zones come from the
transition tables of one versioned zone database (see functions/zones.py).

Day and month order of a/b/yyyy texts is a habit of the writer: one aggregate per writer counts dates that only
one order explains (a part above 12, or only one reading shortly before the arrival), and the majority holds for
all its rows. Defined results: null, blank and unreadable texts, days and hours that no calendar has, local times
skipped by a clock change and unknown zones give null; a local time that occurs twice is the first of the two;
an abbreviation means what it meant in the writer's zone on that date; digits beyond the microsecond are cut.
Repeated rows each get their instant; extra columns are kept.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions.zones import US, local_to_utc, named_to_utc, version
from flowloom.runtime import if_small, micros

# Month names (en, de, fr, es, it, pt, nl), short forms that are no beginning of a name, zone abbreviations with one meaning worldwide.
MONTHS = (
    "january januar jänner janvier enero gennaio janeiro januari", "february februar feber février febrero febbraio fevereiro februari",
    "march märz mars marzo março maart", "april avril abril aprile", "may mai mayo maggio maio mei", "june juni juin junio giugno junho",
    "july juli juillet julio luglio julho", "august août agosto augustus", "september septembre septiembre setiembre settembre setembro",
    "october oktober octobre octubre ottobre outubro", "november novembre noviembre novembro", "december dezember décembre diciembre dicembre dezembro",
)
SHORT_MONTHS = {"mrz": 3, "mrt": 3}
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "JST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "BRT": -180, "BRST": -120,
}

_TIME = r"(?P<h>9{1,2}):(?P<mi>99)(?::(?P<s>99)(?:[.,](?P<f>9+))?)?"
_ZONE = r"(?:\s?(?P<off>[+-]99:?99)|\s?\[(?P<name>[a9_/+-]+)\]|\s?(?P<abbr>a+(?:/[a9_+-]+)*))?"
_DATE_END = r"(?P<sep>[a ])"
# What masks are tried against, in this order.
_PARSERS = {
    "packed": r"(?P<y>9{4})(?P<mo>99)(?P<d>99)(?P<sep>[a ]?)(?P<h>99)(?P<mi>99)(?P<s>99)(?:[.,](?P<f>9+))?" + _ZONE,
    "epoch": r"(?P<epoch>9{9,13}|9{15,19})(?:\.(?P<f>9+))?",
    "year_first": r"(?P<y>9{4})[-/.](?P<mo>9{1,2})[-/.](?P<d>9{1,2})" + _DATE_END + _TIME + _ZONE,
    "slashed": r"(?P<a>9{1,2})/(?P<b>9{1,2})/(?P<y>9{4}) " + _TIME + _ZONE,
    "half_day": r"(?P<a>9{1,2})/(?P<b>9{1,2})/(?P<y>9{4}) " + _TIME + r" ?(?P<ap>aa)" + _ZONE,
    "dotted": r"(?P<d>9{1,2})\.(?P<mo>9{1,2})\.(?P<y>9{4}) " + _TIME + _ZONE,
    "named": r"(?:[a9_]+, )?(?P<d>9{1,2})[-. ]+(?P<mn>a+)\.?[- ](?P<y>9{4}) " + _TIME + _ZONE,
}
PARSERS = {k: re.compile(rf"\A{p}\Z") for k, p in _PARSERS.items()}


@dataclass(frozen=True)
class Layout:
    """Where the parts of a mask's texts stand."""

    kind: str
    spans: dict[str, tuple[int, int]]


@lru_cache(maxsize=65536)
def layouts(mask: str) -> tuple[Layout, ...]:
    """The readings of a mask, decided once; only "hour and two letters" has two (half of the day, or zone)."""
    return tuple(Layout(k, {n: m.span(n) for n in m.groupdict() if m.span(n)[0] >= 0 and m.span(n)[1] > m.span(n)[0]}) for k, p in PARSERS.items() if (m := p.match(mask)))


@lru_cache(maxsize=4096)
def month_of(name: str) -> int:
    """The month a name, or a beginning of three letters or more that only one month has, stands for; else 0."""
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))
    if (n := plain(name)) in SHORT_MONTHS:
        return SHORT_MONTHS[n]
    found = {i + 1 for i, names in enumerate(MONTHS) for x in names.split() if len(n) >= 3 and plain(x).startswith(n)}
    whole = {i + 1 for i, names in enumerate(MONTHS) for x in names.split() if plain(x) == n}
    return min(whole or found) if len(whole or found) == 1 else 0


def _text(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    """The texts of a part."""
    a, z = span
    return np.ascontiguousarray(chars[:, a:z]).view(f"U{z - a}").ravel()


def _each(texts: np.ndarray, value) -> np.ndarray:
    """value(text), called once for each different text."""
    seen, at = np.unique(texts, return_inverse=True)
    return np.array([value(str(t)) for t in seen], dtype=np.int64)[at]


def _whole(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    """The numbers of a part of digits."""
    out = np.zeros(len(chars), dtype=np.int64)
    for i in range(*span):
        out = out * 10 + (chars[:, i].astype(np.int64) - 48)
    return out


def _parse(chars: np.ndarray, at: Layout, zone: np.ndarray, month_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTC µs and validity of texts of one mask, given as an array of characters (texts, places)."""
    n, spans = len(chars), at.spans
    part = lambda name: _whole(chars, spans[name]) if name in spans else np.zeros(n, dtype=np.int64)
    frac = np.zeros(n, dtype=np.int64)
    if "f" in spans:
        a, z = spans["f"]
        frac = _whole(chars, (a, min(z, a + 6))) * 10 ** max(0, 6 - (z - a))
    if at.kind == "epoch":
        digits, value = spans["epoch"][1] - spans["epoch"][0], part("epoch")
        return (value * US + frac if digits <= 11 else value * 1000 if digits <= 14 else value if digits <= 17 else value // 1000), np.ones(n, dtype=bool)
    y, h, mi, s = (part(c) for c in ("y", "h", "mi", "s"))
    ok = np.ones(n, dtype=bool)
    if "sep" in spans:
        sep = chars[:, spans["sep"][0]]
        ok &= (sep == ord("T")) | (sep == ord(" "))
    if at.kind in ("slashed", "half_day"):
        a, b = part("a"), part("b")
        mo, day = np.where(month_first, a, b), np.where(month_first, b, a)
        if at.kind == "half_day":
            half = _each(_text(chars, spans["ap"]), lambda t: {"am": 0, "pm": 12}.get(t.lower(), -1))
            ok &= (half >= 0) & (h >= 1) & (h <= 12)
            h = h % 12 + np.maximum(half, 0)
    else:
        mo, day = _each(_text(chars, spans["mn"]), month_of) if at.kind == "named" else part("mo"), part("d")
    ok &= (mo >= 1) & (mo <= 12) & (day >= 1) & (h < 24) & (mi < 60) & (s < 60) & (y >= 1)
    month = np.where(ok, (y - 1970) * 12 + mo - 1, 0).astype("datetime64[M]")
    length = ((month + 1).astype("datetime64[D]") - month.astype("datetime64[D]")).astype(np.int64)
    ok &= day <= length
    days = month.astype("datetime64[D]").astype(np.int64) + day - 1
    local = ((days * 24 + h) * 60 + mi) * 60 * US + s * US + frac
    if "off" in spans:
        a, z = spans["off"]
        away = (_whole(chars, (a + 1, a + 3)) * 60 + _whole(chars, (z - 2, z))) * 60 * US
        return np.where(chars[:, a] == ord("-"), local + away, local - away), ok
    return _in_zone(local, ok, _text(chars, spans["name"] if "name" in spans else spans["abbr"]) if "name" in spans or "abbr" in spans else None, zone)


def _in_zone(local: np.ndarray, ok: np.ndarray, written: np.ndarray | None, zone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTC µs of local times: in the zone written with them, else the writer's; texts name a region or an abbreviation."""
    us, good = local.copy(), np.zeros(len(local), dtype=bool)
    pairs = pd.DataFrame({"w": "" if written is None else written, "z": zone})
    for (w, z), at in pairs.groupby(["w", "z"], sort=False, dropna=False).indices.items():
        own = z if isinstance(z, str) else None
        if w == "" or "/" in w:
            place = w or own
            us[at], good[at] = local_to_utc(local[at], place) if place else (local[at], False)
        else:
            us[at], good[at] = named_to_utc(local[at], own or "UTC", w)
            if not good[at].all() and w.upper() in ABBREVIATIONS:
                us[at], good[at] = local[at] - ABBREVIATIONS[w.upper()] * 60 * US, True
    return us, ok & good


def _convert(text: pd.Series, mask: pd.Series, zone: pd.Series, month_first: pd.Series) -> pd.Series:
    out, good = np.zeros(len(text), dtype=np.int64), np.zeros(len(text), dtype=bool)
    texts, zones, firsts = text.to_numpy(dtype=object), zone.to_numpy(dtype=object), month_first.to_numpy(dtype=bool)
    for m, at in mask.reset_index(drop=True).groupby(mask.to_numpy(dtype=object), sort=False).indices.items():
        readings = layouts(m)
        chars = np.array(texts[at], dtype=f"U{len(m)}").view(np.uint32).reshape(len(at), len(m)) if readings else None
        for r in readings:
            us, ok = _parse(chars, r, zones[at], firsts[at])
            ok &= ~good[at]
            out[at[ok]], good[at[ok]] = us[ok], True
    return pd.Series(out).astype("Int64").where(pd.Series(good), pd.NA)


@F.pandas_udf(T.LongType())
def _utc_us(text: pd.Series, mask: pd.Series, zone: pd.Series, month_first: pd.Series) -> pd.Series:
    return _convert(text, mask, zone, month_first)


def bare(text: Column) -> Column:
    """Without surrounding white space and quotes."""
    return F.regexp_replace(text, r"^[\s\"' ]+|[\s\"' ]+$", "")


def shape(text: Column) -> Column:
    """The mask with each run of letters as one."""
    return F.regexp_replace(mask(text), "a+", "a")


def mask(text: Column) -> Column:
    """Each digit as 9, each letter as a; letters beyond the basic plane stay, so that a place is a place."""
    return F.regexp_replace(F.translate(text, "0123456789", "9999999999"), r"[\p{L}&&[\u0000-\uFFFF]]", "a")


def date_habits(df: DataFrame, text: Column, writer: str, arrival_us: Column, days_late: int = 3) -> DataFrame:
    """(writer, month_first): the order of day and month that more of the writer's a/b/yyyy texts ask for; day first on a tie."""
    part = lambda i: F.regexp_extract(text, r"^(\d{1,2})/(\d{1,2})/(\d{4}) ", i).cast("int")
    seen = df.where(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4} ")).select(F.col(writer).alias("w"), part(1).alias("a"), part(2).alias("b"), part(3).alias("y"), F.floor(arrival_us / F.lit(86400 * US)).alias("day"))
    as_date = lambda m, d: F.unix_date(F.try_to_date(F.format_string("%04d-%02d-%02d", "y", m, d), "yyyy-MM-dd"))
    late = lambda x: F.coalesce((F.col("day") - x).between(-1, days_late), F.lit(False))
    votes = seen.select("w", "a", "b", late(as_date("b", "a")).alias("as_day_first"), late(as_date("a", "b")).alias("as_month_first"))
    month = F.when(F.col("b") > 12, 1).when(F.col("as_month_first") & ~F.col("as_day_first"), 1).otherwise(0)
    day = F.when(F.col("a") > 12, 1).when(F.col("as_day_first") & ~F.col("as_month_first"), 1).otherwise(0)
    return votes.groupBy("w").agg((F.sum(month) > F.sum(day)).alias("month_first"))


def normalize_timestamps(df: DataFrame, text_col: str, writers: DataFrame, writer_col: str, zone_col: str, arrival_col: str, out: str = "utc_us", zones: str | None = "zone_database") -> DataFrame:
    """df with `out`: µs since 1970 in UTC of text_col, or null, and `zones`: name and version of the zone database used.

    writers gives the zone of each writer_col.
    """
    text = bare(F.col(text_col).cast("string"))
    habits = date_habits(df, text, writer_col, micros(F.col(arrival_col)))
    known = writers.select(F.col(writer_col).alias("__w"), F.col(zone_col).alias("__zone")).dropDuplicates(["__w"]).join(habits.select(F.col("w").alias("__h"), F.col("month_first").alias("__month_first")), F.col("__w") == F.col("__h"), "left").drop("__h")
    known = if_small(known)
    rows = df.join(known, df[writer_col].eqNullSafe(known["__w"]), "left")
    text = bare(df[text_col].cast("string"))
    value = _utc_us(text, mask(text), known["__zone"], F.coalesce(known["__month_first"], F.lit(False)))
    tag = [F.lit(version()).alias(zones)] if zones else []
    return rows.select(*[df[c] for c in df.columns if c not in (out, zones)], value.alias(out), *tag)
