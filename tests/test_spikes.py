import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from cohortloom.operators.chart import ChartParams, frozen_flags, spike_flags
from cohortloom.operators.spikes import flag_readings, flag_rows, limit_table
from cohortloom.plans.training_data import LIMITS, limits

P = ChartParams()
T0 = dt.datetime(2101, 1, 1)
EVENTS = "row_id bigint, hadm_id bigint, itemid bigint, charttime timestamp_ntz, valuenum double, value string, t string, x string, shard int, salt int"


def wave(n, seed=0):
    r = np.random.default_rng(seed)
    return np.round(85 + 6 * np.sin(np.arange(n) / 12) + r.normal(0, 1.5, n))


def test_spikes_found_shifts_not():
    x = wave(120)
    y = x.copy()
    y[20], y[50:52], y[80:83] = 140, 40, 130
    assert set(np.flatnonzero(spike_flags(y, 1.0, P))) == {20, 50, 51, 80, 81, 82}
    z = x.copy()
    z[60:] += 40
    assert not spike_flags(z, 1.0, P).any()
    assert not spike_flags(x + np.arange(120) * 0.5, 1.0, P).any()
    assert not spike_flags(np.array([80.0, 81, 80, 140]), 1.0, P).any()
    assert not spike_flags(np.array([]), 1.0, P).any()


def test_frozen_needs_different_times():
    t = np.arange(20)
    assert frozen_flags(t, np.array([1.0] * 7 + [2.0] * 13), P).sum() == 13
    assert not frozen_flags(np.zeros(20), np.ones(20), P).any()


def rows_of(xs, hadm=1, item=2101, start=0, first=0):
    return [(first + i, hadm, item, T0 + dt.timedelta(minutes=start + 30 * i), float(v), None) for i, v in enumerate(xs)]


def flags(spark, rows):
    e = spark.createDataFrame([(*r, "a", "b", 1, 2) for r in rows], EVENTS)
    items = spark.createDataFrame([(2101,), (2105,), (None,), (2101,)], "itemid bigint")
    got = [(r.row_id, r.reason) for r in flag_rows(e, items, limits(spark)).collect()]
    assert len(got) == len(set(got)) or any(r[0] is None for r in got)
    return dict(got)


def test_rows(spark):
    x = wave(100, 3)
    x[30], x[60], x[70:80] = 150, 999, 77
    rows = rows_of(x)
    rows += [(1000, 1, 2101, rows[30][3], 150.0, None), (1001, 1, 2101, rows[60][3], None, "999 bpm"), (1002, None, 2101, T0, 999.0, None), (1003, 1, 2101, None, 999.0, None), (1004, 1, 2101, T0, None, "?"), (1005, 1, 7, T0, 9e9, None)]
    got = flags(spark, rows)
    assert got == {30: "spike", 1000: "spike", 60: "impossible", 1001: "impossible", **{i: "frozen" for i in range(70, 80)}}
    assert flags(spark, []) == {}


def charted_whole(series):
    """Brute force: every series charted in one piece, in plain Python."""
    bounds = {i: (lo, hi, least) for i, lo, hi, least in LIMITS}
    out = set()
    for (hadm, item), points in series.items():
        points = sorted(set(points))
        t, x = np.array([p[0] for p in points]), np.array([p[1] for p in points])
        low, high, least = bounds[item]
        good = np.flatnonzero((x > low) & (x <= high))
        bad = set(range(len(x))) - set(good.tolist())
        frozen = set(np.flatnonzero(frozen_flags(t, x, P)).tolist())
        spikes = set(good[spike_flags(x[good], least, P)].tolist())
        for i in bad | frozen | spikes:
            out.add((hadm, item, int(t[i]), float(x[i]), "impossible" if i in bad else "spike" if i in spikes else "frozen"))
    return out


def planted(seed, n, step):
    """A course with a lasting change, spikes, frozen stretches, impossible values and copies."""
    r = np.random.default_rng(seed)
    x = wave(n, seed)
    x[n // 2 :] += 30
    for i in r.choice(n - 40, n // 25, replace=False) + 20:
        x[i : i + r.integers(1, 4)] += r.choice([-50, 60, 75])
    for i in r.choice(n - 40, n // 60, replace=False) + 20:
        x[i : i + r.integers(6, 11)] = 91
    for i in r.choice(n - 40, n // 80, replace=False) + 20:
        x[i] = r.choice([0, -5, 999])
    t = 4_000_000_000 + np.arange(n) * step + r.integers(0, step // 4, n)
    points = [(int(a), float(b)) for a, b in zip(t, x)]
    return points + points[::17]


def test_pieces_change_nothing(spark):
    """Flags are those of the whole series wherever it is cut: half-hourly, daily and weekly readings."""
    series = {(1, 2101): planted(1, 900, 1800), (2, 2101): planted(2, 700, 86_400), (3, 2101): planted(3, 500, 7 * 86_400), (4, 2101): planted(4, 60, 1800), (1, 2105): [(t, 37.0) for t in range(0, 600, 60)]}
    want = charted_whole(series)
    reasons = [r for *_, r in want]
    assert min(reasons.count(r) for r in ("spike", "frozen", "impossible")) > 20
    rows = [(h, i, t, x) for (h, i), points in series.items() for t, x in points]
    readings = spark.createDataFrame(rows, "hadm_id bigint, itemid bigint, t bigint, x double")
    for piece, warm in ((1 << 17, 2048), (200, 150), (173, 170)):
        got = [tuple(r) for r in flag_readings(readings, limits(spark), P, piece, warm).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_frozen_over_a_cut(spark):
    """Eight equal daily readings are frozen wherever a piece ends among them."""
    x = wave(60, 9)
    for at in range(12, 21):
        y = x.copy()
        y[at : at + 8] = 77
        readings = spark.createDataFrame([(1, 2101, 86_400 * k, float(v)) for k, v in enumerate(y)], "hadm_id bigint, itemid bigint, t bigint, x double")
        got = {r.t // 86_400 for r in flag_readings(readings, limits(spark), P, 20, 20).collect() if r.reason == "frozen"}
        assert got >= set(range(at, at + 8))


def test_copies_and_no_items(spark):
    x = wave(200, 5)
    for i in (20, 97, 103, 180):
        x[i] += 60
    x[140:152] = 90
    rows = rows_of(x)
    want = {20: "spike", 97: "spike", 103: "spike", 180: "spike", **{i: "frozen" for i in range(140, 152)}}
    assert flags(spark, rows) == want
    assert flags(spark, rows + [(5000 + i, *rows[97][1:]) for i in range(500)]) == {**want, **{5000 + i: "spike" for i in range(500)}}
    assert flag_rows(spark.createDataFrame([(*r, "a", "b", 1, 2) for r in rows], EVENTS), spark.createDataFrame([], "itemid bigint")).count() == 0


def test_limits(spark):
    t = spark.createDataFrame([(1, 0.0, 10.0, 1.0), (1, 2.0, None, None), (2, None, 5.0, None), (None, 1.0, 2.0, 3.0)], "itemid bigint, low double, high double, least double")
    assert limit_table(t) == {1: (2.0, 10.0, 1.0), 2: (-np.inf, 5.0, 0.0)} and limit_table(None) == {}
