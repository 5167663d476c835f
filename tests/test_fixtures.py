"""Small inputs with values known by hand or from an independent computation."""

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortloom.operators import clustering as K
from cohortloom.operators import cohort as C
from cohortloom.operators import events as E
from cohortloom.operators import features as P
from cohortloom.operators import fusion as M
from cohortloom.operators import itemsets as I
from cohortloom.operators import recon as R
from cohortloom.operators import report as B
from cohortloom.operators import scaling as Z
from cohortloom.operators import search as H
from cohortloom.operators import series as S
from cohortloom.operators import similarity as A
from cohortloom.operators import static as D
from cohortloom.operators import stats as X
from cohortloom.operators import taxonomy as T

SERIES = "enc bigint, item string, t bigint, value double"


def one(spark, ts, vs):
    return spark.createDataFrame([(1, "a", t, v) for t, v in zip(ts, vs)], SERIES)


def test_interpolation(spark):
    df = S.interpolate(one(spark, [0, 1, 3, 7, 9], [None, 2.0, None, 8.0, None]))
    rows = df.orderBy("t").collect()
    assert [r.value for r in rows] == [None, 2.0, 4.0, 8.0, 8.0]
    assert [r.value for r in S.deimpute(df).orderBy("t").collect()] == [None, 2.0, None, 8.0, None]


def test_interpolation_like_pandas(spark):
    import pandas as pd

    r = np.random.default_rng(0)
    rows, want = [], {}
    for e in range(20):
        t = np.cumsum(r.integers(1, 9, 30))
        v = np.where(r.random(30) < 0.6, np.nan, r.normal(size=30))
        rows += [(e, "a", int(a), None if b != b else float(b)) for a, b in zip(t, v)]
        for a, b in pd.Series(v, index=t).interpolate(method="index").items():
            want[e, a] = b
    for x in S.interpolate(spark.createDataFrame(rows, SERIES)).collect():
        w = want[x.enc, x.t]
        assert (x.value is None and w != w) or abs(x.value - w) < 1e-9


def test_trusted_override(spark):
    t1, t2, t3 = (dt.datetime(2101, 1, 1, h) for h in (1, 2, 3))
    rows = [(1, "1", t1, 10.0, False), (1, "1", t1, 20.0, False), (1, "1", t1, 7.0, True), (1, "1", t2, 4.0, False), (1, "1", t3, 9.0, True)]
    df = spark.createDataFrame(rows, "enc bigint, item string, ts timestamp_ntz, value double, trusted boolean")
    assert [r.value for r in E.trusted_override(df).orderBy("ts").collect()] == [7.0, 4.0, 9.0]


def test_combine_first(spark):
    k = "t bigint, value double"
    a, b = spark.createDataFrame([(0, 1.0), (1, None)], k), spark.createDataFrame([(0, 9.0), (1, 5.0), (2, 7.0)], k)
    assert [r.value for r in E.combine_first(a, b, ["t"]).orderBy("t").collect()] == [1.0, 5.0, 7.0]


def test_minutes_floor(spark):
    adm = spark.createDataFrame([(1, dt.datetime(2101, 1, 1, 1))], "enc bigint, admit timestamp_ntz")
    ev = spark.createDataFrame([(1, dt.datetime(2101, 1, 1, 0, 58, 59)), (2, dt.datetime(2101, 1, 1))], "enc bigint, ts timestamp_ntz")
    assert [r.t for r in E.minutes_since(ev, adm).collect()] == [-2]


def test_partition_sizes(spark):
    df = S.partition_stats(one(spark, range(7), [float(i) for i in range(7)]), 3, {"n": F.count("*")})
    assert [r.n for r in df.orderBy("part").collect()] == [3, 2, 2]


@pytest.mark.parametrize(("ts", "vs", "want"), [([0, 1, 2, 3], [1, 2, 3, 4], 45.0), ([0, 60, 180], [10, 16, 16], 1.636577), ([0, 5], [3, 3], 0.0), ([4], [1], None)])
def test_trend(spark, ts, vs, want):
    got = S.trend_angle(one(spark, ts, [float(v) for v in vs])).head().angle
    assert got is None if want is None else abs(got - want) < 1e-6


def test_delta_at_equal_times(spark):
    got = S.step_delta(one(spark, [0, 0, 2], [1.0, 5.0, 9.0]), ("t", "value")).orderBy("t").collect()
    assert sorted([r.delta for r in got], key=str) == [2.0, None]


def test_encoding(spark):
    df = S.positional_encoding(one(spark, [0, 30, 60], [0.0] * 3), 60, 4).orderBy("t").collect()
    want = [[0, 1, 0, 1], [-0.988032, 0.154251, 0.92388, 0.382683], [-0.304811, -0.952413, 0.707107, -0.707107]]
    assert np.allclose([[r[f"pe{k}"] for k in range(4)] for r in df], want, atol=1e-6)


def test_body_size(spark):
    t = dt.datetime(2101, 1, 1)
    ev = spark.createDataFrame([(1, t, 1, 150.0), (2, t, 2, 2500.0), (1, t, 3, 70.0), (1, t, 1, 0.0)], "hadm_id bigint, charttime timestamp_ntz, itemid bigint, valuenum double")
    f = spark.createDataFrame([("weight_lb", 1), ("weight_oz", 2), ("height_in", 3)], "field_name string, itemid bigint")
    got = {r.hadm_id: r for r in D.median_of_medians(ev, f).collect()}
    assert abs(got[1].weight_kg - 68.039554) < 1e-5 and abs(got[1].height_cm - 177.8) < 1e-9 and abs(got[2].weight_kg - 70.873731) < 1e-5


def labels(spark, a, b):
    return spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(zip(a, b))], "id bigint, a int, b int")


def test_agreement_fixture(spark):
    t = A.contingency(labels(spark, [0, 0, 0, 1, 1, 1, 2, 2], [0, 0, 1, 1, 1, 2, 2, 2])).persist()
    assert abs(A.rand_index(t).head().ari - 0.238095) < 1e-6
    assert A.jaccard(t).head().jaccard == 0.75
    m = {r.metric: r.score for r in A.all_measures(t.withColumn("g", F.lit("x")), ["g"]).collect()}
    assert abs(m["rand"] - 0.238095) < 1e-6 and m["jaccard"] == 0.75 and abs(m["mutual_info"] - A.mutual_information(t).head().ami) < 1e-12
    q = A.label_quality(spark.createDataFrame([("x", v) for v in [0, 0, 0, 1, 1, 1, 2, 2]], "clustering_id string, label int")).head()
    assert abs(math.log(q.k_effective) - 1.082196) < 1e-6 and not q.trivial and not q.pseudo_trivial


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=2, max_size=60), st.randoms())
def test_mutual_information_properties(xs, rnd):
    def table(a, b):
        out = {}
        for x, y in zip(a, b):
            out[x, y] = out.get((x, y), 0) + 1
        return [(x, y, n) for (x, y), n in out.items()]

    swap = {v: (v + 1) % 5 for v in range(5)}
    assert abs(A.adjusted_mutual_info(table(xs, [swap[v] for v in xs])) - 1) < 1e-6
    ys = xs[:]
    rnd.shuffle(ys)
    assert abs(A.adjusted_mutual_info(table(xs, ys)) - A.adjusted_mutual_info(table(ys, xs))) < 1e-9


def test_random_labels_do_not_agree(spark):
    r = np.random.default_rng(1)
    t = A.contingency(labels(spark, r.integers(0, 10, 20_000), r.integers(0, 10, 20_000))).persist()
    assert abs(A.rand_index(t).head().ari) < 0.01 and A.jaccard(t).head().jaccard < 0.25 and abs(A.mutual_information(t).head().ami) < 0.01


def test_fisher_and_student():
    assert abs(X.fisher_exact(8, 2, 1, 5) - 0.034965) < 1e-6 and abs(X.fisher_exact(1, 9, 11, 3) - 0.002759) < 1e-6
    assert abs(X.student_quantile(0.975, 10) - 2.228139) < 1e-5 and abs(X.student_two_sided(2.228139, 10) - 0.05) < 1e-6


def test_rank_sum(spark):
    rows = [(1, float(v)) for v in (1, 2, 2, 5)] + [(0, float(v)) for v in (3, 4, 6, 7, 8)]
    r = X.rank_sum(spark.createDataFrame(rows, "g int, v double"), "g", "v").filter("g = 1")
    got = r.withColumn("p", X.normal_two_sided("z")).head()
    assert abs(got.z + 1.959592) < 1e-6 and abs(got.p - 0.050044) < 1e-6


def test_rank_sum_of_millions(spark):
    n = 4_000_000
    rows = spark.range(n).select(F.expr("cast(id % 4 = 0 as int)").alias("g"), F.expr("case when id % 4 = 0 then 1.0D else id % 2 + 1.0D end").alias("v"))
    got = X.rank_sum(rows, "g", "v").filter("g = 1").head()
    # A quarter has the value 1 by itself, a quarter of the others with it: ranks 1 to n / 2, the mean of which all of them have.
    z = ((n // 4) * (n // 2 + 1) / 2 - (n // 4) * (n + 1) / 2) / ((n // 4) * (n - n // 4) * (n + 1) / 12) ** 0.5
    assert (got.n_in, got.n_out) == (n // 4, n - n // 4) and abs(got.z / z - 1) < 1e-12


def test_rank_sum_p_of_millions(spark, tmp_path):
    from cohortloom.plans.agreement_plans import rank_sum_p

    n = 4_000_000
    spark.range(8).selectExpr("id as c_custkey", "cast(id as double) as c_acctbal", "'A' as c_mktsegment", "cast(id % 2 as int) as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    # Customers 0 to 7 in turn, but for 1,000 orders that customer 7 has instead of 0.
    who = "case when id < 8000 and id % 8 = 0 then 7 else id % 8 end"
    spark.range(n).selectExpr("id as o_orderkey", f"{who} as o_custkey", "timestamp'1998-01-01' as o_orderdate", "1.0D as o_totalprice", "'F' as o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.lab: r.p_value for r in rank_sum_p(spark, str(tmp_path)).collect()}
    count = [n // 8 - 1000, *[n // 8] * 6, n // 8 + 1000]
    rank = [sum(count[:k]) + (count[k] + 1) / 2 for k in range(8)]
    ins = sum(count[1::2])
    z = (sum(count[k] * rank[k] for k in (1, 3, 5, 7)) - ins * (n + 1) / 2) / math.sqrt(ins * (n - ins) * (n + 1) / 12)
    want = math.erfc(abs(z) / math.sqrt(2))
    assert set(got) == {0, 1} and all(abs(p - want) <= 1e-9 * want for p in got.values())


def test_js_distance(spark):
    df = spark.createDataFrame([(0.5, 0.25), (0.5, 0.25), (0.0, 0.5)], "p double, q double")
    assert abs(df.agg(F.sqrt(F.sum(B.js_distance(F.col("p"), F.col("q"))) / 2).alias("d")).head().d - 0.557923) < 1e-6


def test_kaplan_meier(spark):
    df = spark.createDataFrame([(0, float(t), bool(d)) for t, d in zip((1, 2, 2, 3, 5), (1, 0, 1, 1, 0))], "lab int, t double, died boolean")
    assert np.allclose([r.survival for r in B.kaplan_meier(df, "lab", "t", "died").orderBy("t").collect()], [0.8, 0.6, 0.3, 0.3])
    gone = spark.createDataFrame([(0, 1.0, True), (0, 2.0, True)], "lab int, t double, died boolean")
    assert [r.survival for r in B.kaplan_meier(gone, "lab", "t", "died").orderBy("t").collect()] == [0.5, 0.0]


def test_errors(spark):
    p = spark.createDataFrame([(1, "a", t, float(g), float(r)) for t, (g, r) in enumerate(zip((2.0, 0, 4, 5), (1.0, 3, 5, 0)))], "enc bigint, item string, t bigint, value double, rec double")
    assert R.mape(p).head().mape == 0.375
    e = spark.createDataFrame([(1, "a", 2, 0.5), (1, "b", 6, 0.1)], "enc bigint, item string, n bigint, mse double")
    assert abs(R.encounter_errors(e).head().error - 0.2) < 1e-12
    v = spark.createDataFrame([(float(i),) for i in range(1, 11)], "x double")
    w = R.worst_left_out(v, "x", [10.0]).head()
    assert abs(w.threshold - 9.1) < 1e-9 and w["mean"] == 5.0
    s = spark.createDataFrame([(float(i),) for i in (1, 2, 2, 4, 9)], "x double")
    assert R.percentile_of_score(s, "x", 2.0).head().percentile == 50.0


RULES = [("p", "L", 0, "L_p_q"), ("q", "L", 1, "L_p_q")]


@pytest.mark.parametrize(
    ("p", "q", "want"),
    [
        ([None] * 4, [None] * 4, []),
        ([1, 2, None, None], [None] * 4, [1, 2]),
        ([1, 2, None, None], [3, 4, None, None], [2, 3]),
        ([1, 2] + [None] * 28, [None] * 28 + [3, 4], [1, 2, 3, 4]),
        ([1, 2, 3, None], [None, 1, 2, 3], [1, 2, 3]),
        ([1, 2, 3, None], [9, 8, 7, 6], [9, 8, 7, 6]),
    ],
)
def test_fusion_branches(spark, p, q, want):
    rows = [(1, i, t, None if v is None else float(v)) for i, vs in (("p", p), ("q", q)) for t, v in enumerate(vs)] + [(1, "z", t, 0.0) for t in range(len(p))]
    chart = spark.createDataFrame(rows, "enc bigint, item string, t bigint, value double")
    rules = spark.createDataFrame(RULES, "item string, label string, pos int, name string")
    assert [r.value for r in M.fuse(chart, rules).orderBy("t").collect()] == want


def test_rules(spark):
    l = spark.createDataFrame([("a", ["1", "2"]), ("b", ["3", "4"])], "label string, items array<string>")
    rows = M.expand_rules(l, {"a": []}, {"b": [["4"], ["3"]]})
    assert ("1", "a", 0, 0, "a_1_2", "a") in rows and ("3", "b", 0, 1, "b_3_1", "b (2/2)") in rows
    with pytest.raises(ValueError):
        M.expand_rules(l, {}, {"b": []})
    with pytest.raises(ValueError):
        M.expand_rules(l, {"a": []}, {"b": [["4"]]})


@pytest.mark.parametrize("mode", sorted(Z.SCALERS))
def test_scalers_undo_themselves(spark, mode):
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(i, "ab"[i % 2], float(v)) for i, v in enumerate(r.gamma(2, 3, 200))], "id bigint, item string, value double")
    s = Z.SCALERS[mode]()
    fitted = s.fit(df.select("item", "value"))
    there = s.transform(df, fitted).persist()
    back = {x.id: x.value for x in s.inverse(there, fitted).collect()}
    assert all(abs(back[x.id] - x.value) < 0.02 * max(1, abs(x.value)) for x in df.collect())
    if mode in ("standard", "power"):
        m = there.groupBy("item").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).collect()
        assert all(abs(x.m) < 1e-6 and abs(x.s - 1) < 1e-6 for x in m)
    if mode == "quantile":
        assert abs(there.agg(F.skewness("value").alias("s")).head().s) < 0.2


def test_leakage_barrier(spark):
    df = spark.sql("select 1L as enc, 30.0D as age_years, array('x') as codes, true as FUTURE_survival")
    assert D.model_inputs(df).columns == ["enc", "age_years"]


def test_codes(spark):
    tree = spark.createDataFrame([("038", ["root", "001-139", "038"]), ("03849", ["root", "001-139", "038", "03849"]), ("V10", ["root", "V01-V91", "V10"])], "code string, path array<string>")
    codes = spark.createDataFrame([("038.49",), ("03842",), ("V1047",), ("99",), ("12345",)], "code string")
    found = T.resolve(codes, tree.select(F.col("code").alias("node")))
    got = {r.code: (r.node, r.ancestor) for r in T.ancestor_at(found, T.closure(tree), 2).collect()}
    assert got == {"038.49": ("03849", "038"), "03842": ("038", "038"), "V1047": ("V10", "V10"), "99": (None, "UNKNOWN"), "12345": (None, "UNKNOWN")}


def test_maximal_sets(spark):
    tx = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b"]), (3, ["a", "b", "c"]), (4, ["d"])], "enc bigint, items array<string>")
    got = {tuple(r.itemset) for r in I.maximal(I.frequent(tx, 0.5)).collect()}
    assert got == {("a", "b", "c")}
    n = {tuple(r.itemset): r.n for r in I.support_counts(tx, I.frequent(tx, 0.5), []).collect()}
    assert n["a", "b"] == 3 and n["a", "b", "c"] == 2


def blobs(n=20, k=5, seed=4):
    r = np.random.default_rng(seed)
    return np.concatenate([r.normal(size=(n, 6)) + 12 * r.normal(size=6) for _ in range(k)]), np.repeat(np.arange(k), n)


def test_clusterings_find_blobs(spark):
    x, y = blobs()
    d = K.distances(x)
    same = y[:, None] == y[None, :]
    for label in (K.kmedoids_labels(d, 5), K.cut(K.centroid_linkage(x), len(x), 5)):
        assert ((label[:, None] == label[None, :]) == same).mean() > 0.98
    near = K.density_labels(d, 6.0, 4)
    assert (near >= -1).all() and ((near[:, None] == near[None, :]) == same)[np.ix_(near >= 0, near >= 0)].mean() > 0.95
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, features array<double>")
    sweep = K.sweep(df, "kmedoids", [5]).persist()
    assert K.silhouette(df, sweep).head().silhouette > 0.5
    q = K.technical_quality(df, sweep).head()
    assert q.calinski_harabasz > 100 and q.davies_bouldin < 0


def test_robustness(spark):
    x, y = blobs(12, 3)
    full = spark.createDataFrame([("g", i, int(v)) for i, v in enumerate(y)], "clustering_id string, id bigint, label int")
    boots = C.bootstraps(full, "id", 3, 0.7, 1).join(full, "id").select("boot_id", "clustering_id", "id", "label")
    assert boots.count() == 3 * int(0.7 * 36)
    r = K.robustness(full, boots, times=5).collect()
    assert len(r) == 3 and all(x.is_robust and x.actual > 0.99 for x in r)


def test_picks():
    assert K.cluster_range(10) == [2, 3, 4, 5] and K.cluster_range(500)[-1] == 40
    p = K.spread_positions(30)
    assert p[0] == 0 and p[-1] == 29 and len(p) <= 6 and K.spread_positions(3) == [0, 1, 2]


def test_components(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(60, 2)) @ r.normal(size=(2, 5)) + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, features array<double>")
    c = P.Components(2).fit(df)
    back = c.inverse(c.transform(df)).orderBy("id").collect()
    assert np.allclose([b.features for b in back], x, atol=1e-6) and c.needed(0.99) <= 2
    mean = np.array([b.features for b in c.transform(df).collect()]).mean(0)
    assert np.allclose(mean, 0, atol=1e-9)


def test_trees_and_classifier(spark):
    r = np.random.default_rng(3)
    rows = [(float(a), float(b), int(a > 0.2), [float(a), float(b)]) for a, b in r.normal(size=(400, 2))]
    df = spark.createDataFrame(rows, "a double, b double, y int, features array<double>")
    t = P.trees(df, "y", ["a", "b"], depths=(3,), gains=(2**-4,)).collect()
    assert len(t) == 1 and t[0].accuracy > 0.97
    q = P.classify(df, df, "y").head()
    assert q.f1 > 0.9 and q.auc > 0.98


def test_cohort(spark):
    df = spark.createDataFrame([(i, f"Heart FAILURE {i}" if i % 2 else None) for i in range(1000)], "enc bigint, text string")
    assert C.text_contains_all(df, "text", []).count() == 1000 and C.text_contains_all(df, "text", ["failure", "HEART"]).count() == 500
    n = C.split(df, "enc").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in n} == {"training": 900, "validation": 100}
    assert C.sample_n(df, "enc", 10, 3).exceptAll(C.sample_n(df.repartition(7), "enc", 10, 3)).count() == 0


def test_search(spark):
    df = spark.createDataFrame([("12",), ("1.5",), ("x",), (None,)], "v string").select(H.typed("v").alias("t")).select("t.*")
    assert [tuple(r) for r in df.collect()] == [(12, None, None), (None, 1.5, None), (None, None, "x"), (None, None, "NotSet")]
    assert [r[0] for r in spark.createDataFrame([(50_000,), (1,)], 'n int').select(H.plotted_sample('n')).collect()] == [100, 1]
    e = H.run_estimates(60_000)
    assert e["training_s"] == pytest.approx(375 * 3600) and e["memory_mb"] == 168_000 and e["job_s"] == 7 * 86_400
    assert H.sample_runs({"a": [1, 2], "b": [3]}, 3, 1) == H.sample_runs({"b": [3], "a": [1, 2]}, 3, 1)


def test_mortality_interval(spark):
    df = spark.createDataFrame([(0, i < 3) for i in range(10)] + [(1, False)] * 4, "lab int, died boolean")
    got = {r.lab: r for r in B.mortality_interval(df, "lab", "died").collect()}
    se = math.sqrt(0.3 * 0.7 * 10 / 9) / math.sqrt(10)
    assert abs(got[0].half_width - 2.262157 * se) < 1e-5 and got[1].half_width is None


def test_polynomial(spark):
    df = spark.createDataFrame([(float(i), 2.0 + 3.0 * i) for i in range(20)], "x double, y double")
    coef, lo, hi = B.polynomial(df, "x", "y", 3)
    assert abs(sum(coef) - (2 + 3 * hi)) < 1e-6 and lo == 0
