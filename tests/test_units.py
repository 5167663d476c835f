import pytest

from cohortloom.operators.units import weights_in_kg
from cohortloom.operators.unitscan import build, scan

A = build()
EVENTS = "row_id bigint, hadm_id bigint, itemid bigint, value string, valuenum double, valueuom string, number double, unit string, centre double"


@pytest.mark.parametrize(
    ("text", "unit", "whole"),
    [
        ("70.5", None, None),
        ("151,1lbs.", "lb", None),
        ("72kilogram", "kg", None),
        ("approx 9.9 pounds", "lb", None),
        ("lbs=153.9", "lb", None),
        ("#161.4", "lb", None),
        ("208 lb 10 oz", "lb", 208.625),
        ("5 pounds 12 ounces", "lb", 5.75),
        ("wt: 4623  gm", "g", None),
        ("standing 80", None, None),
        ("stated 70 KG (bed scale)", "kg", None),
        ("lb", "lb", None),
        ("", None, None),
        (None, None, None),
        ("1" * 50_000 + " kg", "kg", None),
    ],
)
def test_scan(text, unit, whole):
    assert scan(text, A) == (unit, whole)


def resolve(spark, rows):
    events = spark.createDataFrame([(*r, None, None, None) for r in rows], EVENTS)
    fields = spark.createDataFrame([("weight_kg", 1), ("weight_lb", 2), ("weight_oz", 3), ("height_cm", 9), ("weight_kg", 1)], "field_name string, itemid bigint")
    return {r.row_id: (r.unit, round(r.kg, 3)) for r in weights_in_kg(events, fields).collect()}


def test_rules(spark):
    got = resolve(
        spark,
        [
            (1, 10, 1, None, 80.0, "kg"),
            (2, 10, 1, None, 176.4, None),  # no unit: pounds agree
            (3, 10, 2, None, 80.5, "lb"),  # valueuom cannot agree: kilograms do
            (4, 10, 1, "177,0 lbs", None, "kg"),  # value goes before valueuom
            (5, 10, 1, None, 0.0, "kg"),
            (6, 10, 1, "unable", None, None),
            (7, 10, 9, None, 180.0, "cm"),
            (8, 11, 3, None, 3100.0, "g"),
            (9, 11, 3, None, 109.0, None),
            (10, None, 2, None, 150.0, None),
            (11, 12, 1, "5 lb 8 oz", None, None),
            (12, 10, 1, None, float("nan"), "kg"),
            (13, 10, 1, None, 80.0, "kg"),
            (13, 10, 1, None, 80.0, "kg"),
        ],
    )
    assert {k: v[0] for k, v in got.items()} == {1: "kg", 2: "lb", 3: "kg", 4: "lb", 8: "g", 9: "oz", 10: "lb", 11: "lb", 13: "kg"}
    assert got[11][1] == round(5.5 * 0.45359237, 3) and got[8][1] == 3.1


def test_empty_and_hot(spark):
    assert resolve(spark, []) == {}
    rows = [(i, 5, 1, None, 70.0 + i % 3, "kg") for i in range(2000)] + [(9999, 5, 1, None, 156.0, "kg")]
    assert resolve(spark, rows)[9999][0] == "lb"
