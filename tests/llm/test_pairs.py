import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortloom.llm.pairs import PairTable, changed_baskets, code_baskets, count_deltas
from cohortloom.llm.queries import ORACLE, QUERIES
from compare import canonical, views

SMALL = "/root/testdata/sf0.001"
ROWS = "basket bigint, item string"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    views(con, SMALL)
    a, b = canonical(QUERIES[name](spark, SMALL).toPandas()), canonical(con.execute(ORACLE[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b) and a.equals(b)


def counts(rows):
    by = {}
    for b, i in set(rows):
        by.setdefault(b, set()).add(i)
    out = {}
    for items in by.values():
        for p in itertools.combinations(sorted(items), 2):
            out[p] = out.get(p, 0) + 1
    return out, len(by)


def state(t):
    return {(r.code_a, r.code_b): r.n for r in t.pairs().collect()}


def test_increments_equal_a_full_count(spark):
    r = random.Random(1)
    one = [(r.randint(0, 40), f"i{r.randint(0, 15)}") for _ in range(200)]
    two = [x for x in one if r.random() < 0.8] + [(r.randint(30, 60), f"i{r.randint(0, 18)}") for _ in range(80)]
    a, b, none = (spark.createDataFrame(sorted(set(x)), ROWS) for x in (one, two, []))
    t = PairTable(spark, buckets=5)
    t.update(None, a)
    assert state(t) == counts(one)[0]
    t.update(a, b)
    want, n = counts(two)
    assert state(t) == want
    s = {(x.code_a, x.code_b): x for x in t.scores().collect()}
    assert set(s) == set(want) and all(x.total == n and x.n_ab == want[k] and abs(x.lift - x.n_ab * n / (x.n_a * x.n_b)) < 1e-9 for k, x in s.items())
    t.update(b, b)
    assert state(t) == want
    assert t.scores(affected_only=True).count() == 0
    t.update(b, none)
    assert state(t) == {} and t.scores().count() == 0


def test_affected_pairs_only(spark):
    a = [(1, "x"), (1, "y"), (2, "x"), (2, "z"), (3, "u"), (3, "v")]
    b = [*a, (2, "y")]
    first, second = spark.createDataFrame(a, ROWS), spark.createDataFrame(b, ROWS)
    t = PairTable(spark, buckets=3)
    t.update(None, first)
    t.update(first, second)
    assert {(r.code_a, r.code_b) for r in t.scores(affected_only=True).collect()} == {("x", "y"), ("y", "z")}
    assert t.scores(affected_only=True).filter("code_a = 'u'").count() == 0


def test_a_large_basket_goes_in_blocks(spark):
    from cohortloom.llm import pairs

    items = [(1, f"{i:04d}") for i in range(300)] + [(2, "0000"), (2, "0001")]
    old = pairs.HELD, pairs.FIRSTS
    pairs.HELD, pairs.FIRSTS = 1000, 40
    try:
        got = {(r.code_a, r.code_b): r.n for r in count_deltas(changed_baskets(None, spark.createDataFrame(items, ROWS))).filter('code_b is not null').collect()}
    finally:
        pairs.HELD, pairs.FIRSTS = old
    assert got == counts(items)[0]


def checked(t, baskets):
    want, n = counts(baskets)
    items = {}
    for _, i in set(baskets):
        items[i] = items.get(i, 0) + 1
    got = {(x.code_a, x.code_b): (x.n_ab, x.n_a, x.n_b, x.total) for x in t.scores().collect()}
    assert got == {k: (c, items[k[0]], items[k[1]], n) for k, c in want.items()}


def test_many_updates_and_a_later_session(spark, tmp_path):
    """Scores that an update leaves alone stay right; the folder holds the current files only; another session
    goes on from the manifest; growth makes more buckets."""
    from cohortloom.llm import pairs

    r = random.Random(3)
    folder = f"file://{tmp_path}"
    rows = []
    old = pairs.SCORE_TABLES, pairs.BUCKET_PAIRS
    pairs.SCORE_TABLES, pairs.BUCKET_PAIRS = 4, 5
    try:
        for k in range(6):
            t = PairTable(spark, folder, 2)
            new = [x for x in rows if r.random() < 0.95] + [(r.randint(0, 20 + 10 * k), f"i{r.randint(0, 4 + 4 * k)}") for _ in range(6 + 12 * k)]
            t.update(spark.createDataFrame(sorted(set(rows)), ROWS), spark.createDataFrame(sorted(set(new)), ROWS))
            rows = new
            checked(t, rows)
            assert t.version == k + 1 and len(t.score_paths) <= 4 and t.buckets >= 2
        left = {p.name for p in tmp_path.iterdir() if p.name.startswith("manifest") and p.suffix == ".json"}
        assert left == {"manifest-6.json"} and not list(tmp_path.glob("v*/deltas")) and len(list(tmp_path.glob("v*/items"))) == 1
    finally:
        pairs.SCORE_TABLES, pairs.BUCKET_PAIRS = old


def test_codes(spark):
    d = spark.createDataFrame([(1, " 38.49 "), (1, "3849"), (1, "v10"), (1, None), (1, ""), (1, " . "), (None, "1")], "hadm_id bigint, icd9_code string").withColumn("basket", F.lit("b")).withColumn("item", F.lit(3))
    got = {(r.basket, r.item) for r in code_baskets(d, d.limit(1)).collect()}
    assert {("d:" in i or "p:" in i) for _, i in got} == {True} and {i for _, i in got if i[0] == "d"} == {"d:3849", "d:V10"}
    assert code_baskets(d.filter(F.lit(False)), None).count() == 0
