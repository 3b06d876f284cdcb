"""Sweep sessions, timestamps and drift on small cases and against brute force."""

import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pytest

from flowloom.functions.names import name_likeness
from flowloom.functions import zones
from flowloom.operators import drift, sweep, timestamps
from flowloom.sources.schema import FEATURES
from tests.conftest import rows

US = 1_000_000
S = "record_id long, loaded_at long, day string, session_key string, us long, flow_duration long, extra string, __t int"


def found(df, **k):
    return rows(sweep.sweep_sessions(df, ["day", "session_key"], "us", "flow_duration", "record_id", 60, 3600, ("loaded_at",), **k))


def test_sweep_cases(spark):
    data = [
        (1, 1, "d", "k", 0, None, "a", 1), (2, 2, "d", "k", 0, None, "a", 1),  # sent again
        (3, 3, "d", "k", 0, None, None, 1),  # differs by a null
        (4, 4, "d", "k", 60 * US, -5, "a", 1), (5, 5, "d", "k", 121 * US, 0, "a", 1),
        (6, 6, "d", None, 0, 0, "a", 1), (7, 7, None, "k", 0, 0, "a", 1), (8, 8, "d", "k", None, 0, "a", 1),
    ]
    df = spark.createDataFrame(data, S)
    assert found(df) == [("d", "k", 0, 60 * US, 3), ("d", "k", 121 * US, 121 * US, 1)]
    assert found(df.where("false")) == []


def test_sweep_against_the_loop(spark):
    rnd = random.Random(9)
    data, want, i = [], [], 0
    for g in range(30):
        t, pts = rnd.randint(0, 10**6), []
        for _ in range(rnd.randint(1, 150)):
            t += rnd.choice([0, 1, 20, 59, 60, 61, 300])
            pts.append((t * US, rnd.choice([None, -1, 0, 5, 100, 1000])))
        cur = None
        for a, d in pts:
            data.append((i, i, "d", f"g{g}", a, None if d is None else d * US, str(i), 0))
            i += 1
            if cur is None or a - end > 60 * US or a - cur[2] > 3600 * US:
                cur and want.append(tuple(cur))
                cur = ["d", f"g{g}", a, a, 0]
            cur[3], cur[4], end = a, cur[4] + 1, a + max(d or 0, 0) * US
        want.append(tuple(cur))
    rnd.shuffle(data)
    df = spark.createDataFrame(data, S)
    assert found(df) == sorted(want, key=str) == found(df, slice_s=7) == found(df, slice_s=10**7)


def utc(spark, items, tz="Europe/Berlin", arrival="2024-11-20 00:00:00"):
    df = spark.createDataFrame([(i, 1, t, datetime.fromisoformat(arrival), "x", 1) for i, t in enumerate(items)], "record_id long, sensor_id int, timestamp string, received_at timestamp_ntz, __zone string, utc_us int")
    sensors = spark.createDataFrame([(1, tz, "s")], "sensor_id int, tz_name string, site string")
    out = timestamps.normalize_timestamps(df, "timestamp", sensors, "sensor_id", "tz_name", "received_at")
    got = [r["utc_us"] for r in out.orderBy("record_id").collect()]
    return [None if x is None else (datetime(1970, 1, 1) + timedelta(microseconds=x)).isoformat() for x in got]


def test_notations(spark):
    same = ["2024-07-01T10:00:00Z", "2024-07-01 12:00:00", "2024-07-01T12:00:00+02:00", "20240701T100000Z", "20240701120000", "1719828000", "1719828000000", "1719828000000000", '"1 Jul 2024 12:00:00 CEST"', " 01-Jul-2024 12:00:00", "1. Juli 2024 12:00:00", "Mon, 01 Jul 2024 15:30:00 +0530", "2024-07-01T06:00:00[America/New_York]", "2024-07-01 12:00:00 Europe/Berlin", "01.07.2024 12:00:00", "2024-07-01 12:00:00,000"]
    assert set(utc(spark, same)) == {"2024-07-01T10:00:00"}
    assert utc(spark, ["1719828000.123", "2024-07-01 10:00:00.1234567Z"]) == ["2024-07-01T10:00:00.123000", "2024-07-01T10:00:00.123456"]


def test_no_instants(spark):
    bad = [None, "", "  ", "--", "n/a", "30/02/2024 10:00:00", "2024-13-45 10:00:00", "0000-00-00 00:00:00", "2024-01-01 25:00:00", "2024-01-01 10:61:00", "Infinity", "2024-03-31 02:30:00", "2024-01-01 10:00:00 QQQ", "2024-01-01 10:00:00 No/Where", "x" * 50_000, "13/1/2024 13:00:00 PM"]
    assert utc(spark, bad) == [None] * len(bad)


def test_repeated_hour_is_the_first(spark):
    assert utc(spark, ["2024-10-27 02:30:00", "2024-10-27 02:30:00 CET"]) == ["2024-10-27T00:30:00", "2024-10-27T01:30:00"]


def test_habits(spark):
    assert utc(spark, ["25/12/2023 1:00", "3/4/2024 1:00"], "UTC")[1] == "2024-04-03T01:00:00"
    assert utc(spark, ["12/25/2023 1:00:00 AM", "3/4/2024 12:00:00 am"], "UTC")[1] == "2024-03-04T00:00:00"
    assert utc(spark, ["11/2/2024 1:00"], "UTC", "2024-11-02 01:02:00") == ["2024-11-02T01:00:00"]


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "America/Sao_Paulo", "UTC"])
def test_zone_tables_against_zoneinfo(zone):
    rnd = np.random.default_rng(1)
    local = rnd.integers(946684800, 1900000000, 3000) * US
    got, ok = zones.local_to_utc(local, zone)
    tz = ZoneInfo(zone)
    for x, g, o in zip(local.tolist(), got.tolist(), ok.tolist(), strict=True):
        naive = datetime(1970, 1, 1) + timedelta(microseconds=x)
        want = naive.replace(tzinfo=tz, fold=0).astimezone(timezone.utc)
        back = want.astimezone(tz).replace(tzinfo=None)
        assert o == (back == naive)
        if o:
            assert g == int((want - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


def lines(spark, files):
    data, i = [], 0
    for n, text in enumerate(files, 1):
        for j, line in enumerate(text):
            data.append((i, "p", n, j, line))
            i += 1
    return spark.createDataFrame(data, "line_id long, series string, file_no int, line_no int, raw_line string")


def test_changes(spark):
    files = [
        ["Destination Port,Flow Bytes/s,Label", "80,1.5,BENIGN", "443,2.5,Bot"],
        ["label,destination-port,flow_bytes_s", "Bot,443,7.25", "Bot,80,3.0"],
        ["Label,dst_port,flow_bytes_s,rack", "Bot,0x01bb,1.0,a1", '"Bo,t",0x0050,Infinity,b2'],
        ["Label,dst_port,rack", "Bot,0x01bb,a1", "Bot,,"],
        ["Label,dst_port,rack,flow_byte_rate", "Bot,80,a1,3", ",,,"],
    ]
    got = rows(drift.schema_changes(lines(spark, files), list(FEATURES) + ["label"]).select("file_no", "field_name", "change_kind"))
    assert got == sorted([(3, "destination_port", "renamed"), (3, "destination_port", "retyped"), (3, "rack", "added"), (4, "flow_bytes_s", "removed"), (5, "destination_port", "retyped"), (5, "flow_bytes_s", "added")], key=str)
    table = drift.unify(lines(spark, files), {"destination_port": "bigint", "flow_bytes_s": "double", "label": "string"})
    assert [r["destination_port"] for r in table.where("file_no = 3").orderBy("line_no").collect()] == [443, 80]
    assert table.where("file_no = 3 AND line_no = 2").first()["label"] == "Bo,t"
    assert drift.schema_changes(lines(spark, files).where("false"), ["label"]).count() == 0


def test_odd_files(spark):
    files = [["a,a,B,", "1,2,3,4,5", None, "7"], ["A,b", ",", ""], ["a,b", "x,1"]]
    assert rows(drift.schema_changes(lines(spark, files), ["label"])) == [("p", 3, "a", "retyped")]


def test_assignment():
    rnd = random.Random(4)
    for n, m in [(2, 3), (5, 5), (9, 9), (8, 10), (10, 3)]:
        gain = [[rnd.random() for _ in range(m)] for _ in range(n)]
        got = drift.assign(gain, 0.0)
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got) == min(n, m)
    big = [[rnd.random() for _ in range(8)] for _ in range(7)]
    import itertools

    best = max(sum(big[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(8), 7))
    assert sum(big[i][j] for i, j in drift.assign(big, 0.0)) == pytest.approx(best)


def test_name_likeness():
    fields = FEATURES
    for a, b in [("destination_port", "dport"), ("flow_bytes_s", "flowbytespersec"), ("fwd_header_length_1", "fwdhdrlength1"), ("total_backward_packets", "tot_bwd_pkts")]:
        assert name_likeness(a, b, fields) > 0.8
    for a, b in [("destination_port", "inbound"), ("flow_bytes_s", "ttl_min"), ("total_backward_packets", "queue_depth")]:
        assert name_likeness(a, b, fields) < 0.4


def test_layouts_are_decided_by_masks():
    kinds = lambda m: [x.kind for x in timestamps.layouts(m)]
    assert kinds("99999999a999999a") == ["packed"] and kinds("9999999999.999") == ["epoch"] and kinds("a/a") == [] and kinds("99999999999999") == ["packed"]
    assert kinds("9/9/9999 9:99 aa") == ["slashed", "half_day"]
    assert timestamps._convert(pd.Series([], dtype=object), pd.Series([], dtype=object), pd.Series([], dtype=object), pd.Series([], dtype=bool)).empty


def test_month_names():
    names = "January FÉVRIER mars Abr mai juin juillet août Sept. Okt noviembre déc"
    assert [timestamps.month_of(n.strip(".")) for n in names.split()] == list(range(1, 13))
    assert timestamps.month_of("jui") == timestamps.month_of("ma") == timestamps.month_of("hello") == 0


def test_far_and_old_times_and_moved_abbreviations(spark):
    assert utc(spark, ["2045-07-01 12:00:00", "2039-12-01 12:00:00", "1965-07-01 12:00:00", "9000-07-01 12:00:00"], "Europe/Paris") == ["2045-07-01T10:00:00", "2039-12-01T11:00:00", "1965-07-01T11:00:00", "9000-07-01T10:00:00"]
    assert utc(spark, ["2012-06-01 12:00:00 MSK", "2020-06-01 12:00:00 MSK"], "Europe/Moscow") == ["2012-06-01T08:00:00", "2020-06-01T09:00:00"]
    assert utc(spark, ["1 juin 2024 12:00:00", "1 juillet 2024 12:00:00"], "Europe/Paris") == ["2024-06-01T10:00:00", "2024-07-01T10:00:00"]
    assert zones.version().split()[0] in ("tzdata", "system") and zones.zone("../etc/passwd") is None


def test_cuts_of_long_runs_against_the_loop(spark):
    rnd = random.Random(21)
    data, want = [], []
    for g in range(6):
        t, pts = rnd.randint(0, 10**9), []
        for _ in range(rnd.choice([3, 900, 1500])):
            t += rnd.choice([0, 1, 7, 50_000, 400_000, 3 * US, 11 * US])
            pts.append(t)
        starts = [pts[0]]
        for x in pts:
            if x - starts[-1] > 60 * US:
                starts.append(x)
        want.append((f"g{g}", tuple(starts[1:])))
        data += [(f"g{g}", x) for x in pts]
    rnd.shuffle(data)
    points = spark.createDataFrame(data, "k string, __t long").repartition(3)
    for bucket in (1, 100_000, 7 * US):
        got = {(r["k"], tuple(r["__cuts"])) for r in sweep.cut_points(points, ["k"], 60 * US, bucket).collect()}
        assert got == set(want)


def test_values_alone_can_carry_a_rename(spark):
    """Renames to names that share nothing: at least 0.9 are found, and another field of other values isn't taken for one."""
    rnd = random.Random(8)
    make = {"destination_port": lambda: rnd.choice([80, 443, 22, 53, rnd.randint(1024, 65535)]), "flow_bytes_s": lambda: round(rnd.lognormvariate(9, 2), 3), "label": lambda: rnd.choice(["BENIGN", "Bot", "DDoS"]), "fwd_packet_length_max": lambda: rnd.randint(0, 1500), "flow_duration": lambda: rnd.randint(10**3, 10**8)}
    found = wrong = 0
    fields = list(make)
    data, i = [], 0
    for n, f in enumerate(fields * 8):
        other = fields[(fields.index(f) + 2) % len(fields)]
        for file, (name, value) in enumerate([(f, make[f]), (f"zq{n}", make[f]), (f"xj{n}", make[other])], 1):
            data.append((i, f"s{n}", file, 0, name))
            data += [(i := i + 1, f"s{n}", file, j, str(value())) for j in range(1, 61)]
    df = spark.createDataFrame(data, "line_id long, series string, file_no int, line_no int, raw_line string")
    got = rows(drift.schema_changes(df, fields).select("series", "file_no", "change_kind"))
    found = sum(x[1:] == (2, "renamed") for x in got)
    wrong = sum(x[1:] == (3, "renamed") for x in got)
    assert found >= 0.9 * len(fields) * 8 and wrong <= 0.05 * len(fields) * 8
