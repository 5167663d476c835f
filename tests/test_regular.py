import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from cohortloom.operators.regular import BLOCK, RANK, empty_runs, fit, regular_series

T0 = dt.datetime(2101, 1, 1)
EVENTS = "hadm_id bigint, itemid bigint, charttime timestamp_ntz, valuenum double, value string, slot int, x int, cells string"


def make(spark, rows):
    return spark.createDataFrame([(*r, None, 1, 2, "c") for r in rows], EVENTS)


def grid(spark):
    return spark.createDataFrame([(1, 60), (2, 240), (None, 60)], "itemid bigint, step_min int")


def slot(h):
    return (int(dt.datetime(2101, 1, 1, tzinfo=dt.timezone.utc).timestamp()) + 3600 * h) // 3600


def test_runs_against_brute_force(spark):
    r = random.Random(2)
    rows, want = [], set()
    for hadm in range(12):
        filled = sorted(r.sample(range(300), r.randint(1, 60)))
        rows += [(hadm, 1, T0 + dt.timedelta(hours=h, minutes=r.randint(0, 59)), 80.0 + r.random()) for h in filled for _ in range(r.choice([1, 1, 2]))]
        want |= {(hadm, 1, slot(a) + 1, slot(b) - 1) for a, b in zip(filled, filled[1:]) if b - a > 1}
    rows += [(0, 1, T0 + dt.timedelta(hours=150), None), (None, 1, T0, 1.0), (0, 3, T0, 1.0), (0, 1, None, 1.0)]
    rows += [(50, 1, T0, 1.0), (50, 1, T0 + dt.timedelta(hours=200_000), 2.0)]  # more empty slots than a slice
    want |= {(50, 1, slot(1), slot(199_999))}
    s = regular_series(fit(make(spark, rows), grid(spark)))
    runs = empty_runs(s).collect()
    assert {(x.hadm_id, x.itemid, x.slot_from, x.slot_to) for x in runs} == want and len(runs) == len(want)
    assert sum(x.n_filled for x in runs) == s.filter("state = 'filled'").count()
    s = s.toPandas()
    assert not s.duplicated(["hadm_id", "itemid", "slot"]).any()
    span = s.groupby("hadm_id")["slot"].agg(["min", "max", "size"])
    assert ((span["max"] - span["min"] + 1) == span["size"]).all()
    seen = s[s.state == "observed"]
    assert seen.x.notna().all() and s[s.state == "filled"].x.notna().all() and s[s.state == "marked"].x.isna().all()


def course(spark, sources=150):
    """Series that share their course over a block, some cells held out."""
    r = np.random.default_rng(1)
    rows, truth = [], {}
    for hadm in range(sources):
        a, b, start = r.normal(80, 10), r.normal(0, 8), int(r.integers(0, 10**6))
        for c in range(BLOCK):
            v = a + b * np.cos(np.pi * (c + 0.5) / BLOCK) + r.normal(0, 0.3)
            if 0 < c < BLOCK - 1 and r.random() < 0.4:
                truth[hadm, start + c] = v
            else:
                rows.append((hadm, 1, dt.datetime(1970, 1, 1) + dt.timedelta(hours=start + c), float(v)))
    return fit(make(spark, rows), grid(spark)), truth


def test_fill_beats_the_mean(spark):
    """Held-out cells of series that share their course are met better than by each series' mean."""
    rows, truth = course(spark)
    s = regular_series(rows).toPandas().set_index(["hadm_id", "slot"])
    mean = s[s.state == "observed"].groupby("hadm_id").x.mean()
    filled = [(s.x[k] - v, mean[k[0]] - v) for k, v in truth.items()]
    assert len(filled) > 1000 and (s.state[list(truth)] == "filled").all()
    assert np.mean([e[0] ** 2 for e in filled]) < 0.2 * np.mean([e[1] ** 2 for e in filled])


def test_without_factors_nothing_is_filled(spark):
    """The filled slots of the series and of its runs come from the factorisation."""
    rows, truth = course(spark, 20)
    none = regular_series(rows, lambda x, seen: np.zeros((BLOCK, RANK)))
    assert none.filter("state = 'filled'").count() == 0 and none.filter("state = 'marked'").count() == len(truth)
    assert empty_runs(none).agg(F.sum("n_filled")).head()[0] == 0
    assert empty_runs(regular_series(rows)).agg(F.sum("n_filled")).head()[0] == len(truth)


def test_panels(spark):
    """More sources than a panel takes are split; every cell still comes out once."""
    from cohortloom.operators import regular

    rows, truth = course(spark)
    old = regular.PANEL
    regular.PANEL = 40
    try:
        s = regular_series(rows).toPandas()
    finally:
        regular.PANEL = old
    assert len(s) == 150 * BLOCK and (s.state == "filled").sum() == len(truth)


def test_empty(spark):
    e = make(spark, [(1, 1, T0, 2.0)])
    for events, items in ((e.filter(F.lit(False)), grid(spark)), (e, grid(spark).filter(F.lit(False)))):
        s = regular_series(fit(events, items))
        assert s.count() == 0 and empty_runs(s).count() == 0
    assert [(r.x, r.state) for r in regular_series(fit(e, grid(spark))).collect()] == [(2.0, "observed")]
