"""Transition tables of time zones, from one named and versioned zone database."""

from __future__ import annotations

import io
import struct
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo

import numpy as np

US = 1_000_000
WEEK = 7 * 86400
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
CYCLE_YEARS = 400  # after so many years the calendar repeats, weekdays included
CYCLE_S = 146_097 * 86400


@lru_cache(maxsize=1)
def database() -> tuple[object, str]:
    """(folder, version): the tzdata package where it is installed, else the system's first folder; never a mix of both."""
    try:
        from importlib.resources import files

        import tzdata

        return files("tzdata") / "zoneinfo", f"tzdata {tzdata.IANA_VERSION}"
    except ImportError:
        folder = next((Path(p) for p in TZPATH if Path(p).is_dir()), Path("/usr/share/zoneinfo"))
        for name, pick in (("+VERSION", lambda t: t.strip()), ("tzdata.zi", lambda t: t.split("\n", 1)[0].replace("# version ", ""))):
            if (folder / name).exists():
                return folder, f"system {pick((folder / name).read_text())}"
        return folder, "system of unknown version"


def version() -> str:
    return database()[1]


@dataclass(frozen=True)
class Zone:
    """UTC seconds of the changes, and the offset (seconds) and abbreviation before, between and after them."""

    at: np.ndarray
    offsets: np.ndarray
    names: tuple[str, ...]


def _read(raw: bytes) -> tuple[list[int], list[tuple[int, str]]]:
    """Changes and what holds before, between and after them, from a TZif file of version 2 or later (RFC 8536)."""
    head = struct.Struct(">4sc15x6l")
    magic, _, n_utc, n_std, n_leap, n_at, n_kind, n_text = head.unpack_from(raw)
    if magic != b"TZif":
        raise ValueError("no zone file")
    skip = head.size + n_at * 5 + n_kind * 6 + n_text + n_leap * 8 + n_std + n_utc
    _, _, _, _, _, n_at, n_kind, n_text = head.unpack_from(raw, skip)
    pos = skip + head.size
    at = list(struct.unpack_from(f">{n_at}q", raw, pos))
    which = raw[pos + 8 * n_at : pos + 9 * n_at]
    pos += 9 * n_at
    kinds = [struct.unpack_from(">lBB", raw, pos + 6 * i) for i in range(n_kind)]
    text = raw[pos + 6 * n_kind : pos + 6 * n_kind + n_text]
    named = [(k[0], text[k[2] :].split(b"\0", 1)[0].decode("ascii", "replace")) for k in kinds]
    first = next((i for i, k in enumerate(kinds) if not k[1]), 0)
    return at, [named[first], *[named[i] for i in which]]


@lru_cache(maxsize=2048)
def zone(name: str, far: bool = False) -> Zone | None:
    """The table of a zone, None for a name the database lacks; `far`: with a whole calendar cycle after the last listed change."""
    if not name or name.startswith(("/", ".")) or ".." in name:
        return None
    try:
        raw = (database()[0] / name).read_bytes()
        at, held = _read(raw)
        rule = ZoneInfo.from_file(io.BytesIO(raw), key=name)
    except (OSError, ValueError, struct.error):
        return None
    now = lambda t: ((x := EPOCH + timedelta(seconds=t)).astimezone(rule).utcoffset().total_seconds(), x.astimezone(rule).tzname())
    # after the last listed change the zone's own rule goes on; its changes are months apart, so one a week is the most
    start = max([*at[-1:], 0])
    end = CYCLE_S + (2040 - 1970) * 366 * 86400 if far else (2040 - 1970) * 366 * 86400
    for t in range(start + WEEK, end, WEEK):
        if now(t) != (last := (held[-1][0], held[-1][1])):
            low, high = t - WEEK, t
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if now(mid) == last else (low, mid)
            at.append(high)
            held.append((int(now(high)[0]), now(high)[1]))
    return Zone(np.array(at, dtype=np.int64), np.array([h[0] for h in held], dtype=np.int64), tuple(h[1] for h in held))


def _table_for(local_us: np.ndarray, name: str) -> tuple[Zone | None, np.ndarray]:
    """The table, and the local times moved back by whole calendar cycles into what it covers."""
    far = (2039 - 1970) * 365 * 86400 * US
    if not len(local_us) or local_us.max() < far:
        return zone(name), local_us
    cycles = np.maximum(0, (local_us - far) // (CYCLE_S * US))
    return zone(name, True), local_us - cycles * CYCLE_S * US


def local_to_utc(local_us: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """UTC µs and validity of local µs: the earlier instant of a repeated hour, none in a skipped one."""
    table, seen = _table_for(local_us, name)
    if table is None:
        return local_us, np.zeros(len(local_us), dtype=bool)
    ends = (table.at + table.offsets[:-1]) * US  # local time at which each offset's reign ends
    i = np.searchsorted(np.maximum.accumulate(ends) if len(ends) else ends, seen, side="right")
    starts = np.concatenate([[np.iinfo(np.int64).min], (table.at + table.offsets[1:]) * US])
    return local_us - table.offsets[i] * US, seen >= starts[i]


def named_to_utc(local_us: np.ndarray, name: str, abbreviation: str) -> tuple[np.ndarray, np.ndarray]:
    """UTC µs and validity of local µs that carry an abbreviation of the zone: the offset it stood for on that date."""
    table, seen = _table_for(local_us, name)
    utc, ok = local_us.copy(), np.zeros(len(local_us), dtype=bool)
    if table is None:
        return utc, ok
    means = np.array([n.upper() == abbreviation.upper() for n in table.names])
    for offset in dict.fromkeys(table.offsets[means][::-1].tolist()):  # the latest meaning first
        i = np.searchsorted(table.at, (seen - offset * US) // US, side="right")
        held = ~ok & means[i] & (table.offsets[i] == offset)
        utc[held], ok[held] = local_us[held] - offset * US, True
    if means.any():  # not in force on that date: the meaning it last had
        utc[~ok] = local_us[~ok] - int(table.offsets[means][-1]) * US
        ok[:] = True
    return utc, ok
