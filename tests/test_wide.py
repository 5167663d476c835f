import datetime as dt

from pyspark.sql import functions as F

from cohortloom.operators.wide import cell_values, differing_cells, item_types, wide_table

T0 = dt.datetime(2101, 1, 1)
EVENTS = "hadm_id bigint, itemid bigint, charttime timestamp_ntz, storetime timestamp_ntz, value string, valuenum double, word string, is_text string, number int"


def at(m):
    return T0 + dt.timedelta(minutes=m)


def make(spark, rows):
    return spark.createDataFrame([(h, i, c, c and c + dt.timedelta(minutes=k), v, n, "x", "y", 1) for k, (h, i, c, v, n) in enumerate(rows)], EVENTS)


def items(spark):
    return spark.createDataFrame([(1, "Numeric"), (2, "Text"), (3, None), (4, None), (1, "Numeric")], "itemid bigint, param_type string")


ROWS = [
    (7, 1, at(0), None, 5.0),
    (7, 1, at(0), "5,0", None),
    (7, 1, at(1), None, 5.0),
    (7, 1, at(1), "6 mL", None),
    (7, 2, at(0), " Pink ", None),
    (7, 2, at(0), "PINK", None),
    (7, 2, at(1), "pale", None),
    (7, 2, at(1), "pink", None),
    (7, 3, at(0), None, 1.5),
    (7, 4, at(0), "x3", None),
    (7, 4, at(0), "X2", None),
    (7, 1, at(2), "---", None),
    (7, 1, at(3), "", None),
    (7, 1, at(3), None, None),
    (None, 1, at(3), None, 1.0),
    (7, None, at(3), None, 1.0),
    (7, 1, None, None, 1.0),
    (8, 5, at(0), None, 2.0),
]


def test_types_and_marks(spark):
    e = make(spark, ROWS)
    t = item_types(e, items(spark))
    assert {r.itemid: r.is_text for r in t.collect()} == {1: False, 2: True, 3: False, 4: True, 5: False}
    marks = {(r.hadm_id, r.itemid, r.charttime_s) for r in differing_cells(cell_values(e, t), t).collect()}
    s = int(dt.datetime(2101, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    assert marks == {(7, 1, s + 60), (7, 2, s + 60), (7, 4, s)}


def test_wide_rows(spark):
    e = make(spark, ROWS)
    t = item_types(e, items(spark))
    rows = {(r.hadm_id, r.charttime): r for r in wide_table(cell_values(e, t), t).collect()}
    assert set(rows) == {(7, at(0)), (7, at(1)), (8, at(0))}
    r = rows[7, at(0)]
    assert (r.n_1, r.t_2, r.n_3, r.t_4, r.n_5) == (5.0, "pink", 1.5, "x2", None)
    assert sorted(r.differing) == [4] and rows[7, at(1)].n_1 == 5.5 and rows[7, at(1)].t_2 == "pink"


def test_empty_skip_and_copies(spark):
    e = make(spark, ROWS)
    none = e.filter(F.lit(False))
    t = item_types(none, items(spark))
    assert wide_table(cell_values(none, t), t).count() == 0 and differing_cells(cell_values(none, t), t).count() == 0
    t = item_types(e, items(spark), spark.createDataFrame([(2,), (4,)], "itemid bigint"))
    assert {r.itemid for r in differing_cells(cell_values(e, t), t).collect()} == {1}
    many = make(spark, [(1, 1, at(0), None, 3.0)] * 3000 + [(1, 1, at(0), None, 4.0)])
    t = item_types(many, items(spark))
    assert differing_cells(cell_values(many, t), t).count() == 1


def test_a_value_marks_where_it_meets_another(spark):
    """Marks and means are those of brute force however the buckets are sliced, moments with many values too."""
    import random

    from cohortloom.operators import wide

    r = random.Random(4)
    rows = [(r.randint(1, 3), r.choice([1, 2, 3]), at(r.randint(0, 5)), None, None) for _ in range(400)]
    rows = [(h, i, c, r.choice(["a", "B ", "b", "c"]), None) if i == 2 else (h, i, c, None, float(r.randint(1, 3))) for h, i, c, _, _ in rows]
    rows += [(9, 1, at(0), None, float(k % 40)) for k in range(80)]
    want: dict = {}
    for h, i, c, v, n in rows:
        want.setdefault((h, i, c), []).append(v.strip().lower() if i == 2 else n)
    e = make(spark, rows)
    t = item_types(e, items(spark))
    old = wide.CELLS
    for size in (old, 20):
        wide.CELLS = size
        try:
            got = wide_table(cell_values(e, t), t).collect()
        finally:
            wide.CELLS = old
        assert len(got) == len({k[::2] for k in want})
        for x in got:
            assert sorted(x.differing) == [i for i in (1, 2, 3) if len(set(want.get((x.hadm_id, i, x.charttime), []))) > 1]
            for i, name in ((1, "n_1"), (2, "t_2"), (3, "n_3")):
                values = want.get((x.hadm_id, i, x.charttime))
                assert x[name] == (None if values is None else values[-1] if i == 2 else x[name]) and (i == 2 or values is None or abs(x[name] - sum(values) / len(values)) < 1e-9)
