import random

from pyspark.sql import functions as F

from cohortloom.operators.intervals import periods_and_gaps, stay_intervals

SCHEMA = "scope string, entity_id bigint, start_s bigint, end_s bigint"


def brute(rows):
    by = {}
    for scope, e, s, z in rows:
        if None not in (scope, e, s, z) and z > s:
            by.setdefault((scope, e), []).append((s, z))
    out = set()
    for (scope, e), xs in by.items():
        merged = []
        for s, z in sorted(xs):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], z)
            else:
                merged.append([s, z])
        out |= {(scope, e, "period", s, z) for s, z in merged}
        out |= {(scope, e, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


def run(spark, rows, width=64, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = [tuple(r) for r in periods_and_gaps(df, width).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_random_against_brute_force(spark):
    r = random.Random(3)
    rows = []
    for _ in range(600):
        s = r.randint(-500, 3000)
        rows.append((r.choice("ab"), r.randint(0, 12), s, s + r.choice([-5, 0, 1, 3, 20, 64, 200, 700])))
    rows += rows[:50]
    assert run(spark, rows) == brute(rows)


def test_shard_edges(spark):
    rows = [("a", 1, 0, 64), ("a", 1, 64, 128), ("a", 1, 128, 640), ("a", 2, 10, 64), ("a", 2, 65, 70), ("a", 3, -64, 0), ("a", 3, 0, 1), ("a", 4, 5, 1000), ("a", 4, 2000, 2001)]
    assert run(spark, rows) == brute(rows)


def test_nulls_empty_and_hot_entity(spark):
    rows = [(None, 1, 0, 5), ("a", None, 0, 5), ("a", 1, None, 5), ("a", 1, 0, None), ("a", 1, 5, 5), ("a", 1, 9, 2)]
    assert run(spark, rows) == set()
    assert run(spark, []) == set()
    hot = [("a", 7, 10 * i, 10 * i + 7) for i in range(4000)] + [("a", 7, 3, 9)] * 3000
    assert run(spark, hot, width=4096) == brute(hot)


def test_extra_columns_and_times(spark):
    icu = spark.sql("select 1L as hadm_id, timestamp_ntz'2101-01-01 00:00:00' as intime, timestamp_ntz'2101-01-01 01:00:00' as outtime, 'x' as scope, 5L as entity_id, 9 as runs")
    adm = spark.sql("select 2L as subject_id, timestamp_ntz'2101-01-01 00:00:00' as admittime, timestamp_ntz'2101-01-02 00:00:00' as dischtime, 7 as start_s").limit(1)
    got = periods_and_gaps(stay_intervals(icu, adm)).orderBy("scope").collect()
    assert [(r.scope, r.entity_id, r.kind, r.end_s - r.start_s) for r in got] == [("hospital", 2, "period", 86_400), ("icu", 1, "period", 3_600)]
    assert periods_and_gaps(stay_intervals(icu.filter(F.lit(False)), adm.filter(F.lit(False)))).count() == 0
