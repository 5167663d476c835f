"""Operators that once did less than the whole job."""

import numpy as np

from cohortloom.operators import clustering as K
from cohortloom.operators import features as P
from cohortloom.operators import series as S

SERIES = "enc bigint, item string, t bigint, value double"


def test_padding_cuts_nothing(spark):
    rows = [(1, "a", t, float(t)) for t in range(7)] + [(2, "a", 5, 9.0), (3, "a", 2, 2.0), (3, "a", 1, 1.0), (3, "b", 1, 4.0)]
    s = spark.createDataFrame(rows, SERIES)
    got = {(r.enc, r.item, r.chunk): (r.batch, r.n, r.xs) for r in P.padded_batches(s, -1.0, batch=2, chunk=3).collect()}
    assert got == {
        (1, "a", 0): (0, 7, [0.0, 1.0, 2.0]),
        (1, "a", 1): (0, 7, [3.0, 4.0, 5.0]),
        (1, "a", 2): (0, 7, [6.0]),
        (2, "a", 0): (0, 1, [9.0, -1.0, -1.0]),
        (2, "a", 1): (0, 1, [-1.0, -1.0, -1.0]),
        (2, "a", 2): (0, 1, [-1.0]),
        (3, "a", 0): (1, 2, [1.0, 2.0]),
        (3, "b", 0): (1, 1, [4.0, -1.0]),
    }
    cut = P.padded_batches(s, -1.0, batch=2, most=2, chunk=3).filter("enc < 3").orderBy("enc").collect()
    assert [(r.n, r.xs) for r in cut] == [(7, [0.0, 1.0]), (1, [9.0, -1.0])]


def test_support_of_sets_of_any_size(spark):
    import cohortloom.plans.report_plans as Q

    got = Q.itemset_support(spark, "/root/testdata/sf0.001").collect()
    assert max(r.itemset.count("|") + 1 for r in got) > 2
    assert len({r.itemset for r in got if r.itemset.count("|") == 2}) == 20


def test_series_keep_signals_apart(spark):
    s = spark.createDataFrame([(1, "a", 0, 1.0), (1, "a", 1, 4.0), (1, "b", 0, 90.0), (2, "b", 0, 7.0)], SERIES)
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "item string")
    got = {(r.enc, r.item): (r.median, r.low, r.high) for r in S.signal_stats(s, s, items).collect()}
    none = (None, None, None)
    assert got == {(1, "a"): (2.5, 1.0, 4.0), (1, "b"): (90.0, 90.0, 90.0), (1, "c"): none, (2, "a"): none, (2, "b"): (7.0, 7.0, 7.0), (2, "c"): none}


def silhouette_score(x, y):
    out = []
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        own = y == y[i]
        a, b = d[own].sum() / max(own.sum() - 1, 1), min(d[y == c].mean() for c in set(y.tolist()) - {int(y[i])})
        out.append((b - a) / max(a, b) if own.sum() > 1 else 0.0)
    return np.mean(out)


def test_silhouette_beyond_the_matrix(spark, monkeypatch):
    r = np.random.default_rng(0)
    n = K.MAX_POINTS + 500
    y = r.integers(0, 4, n)
    y[0] = 9  # a cluster of one point
    x = r.normal(size=(n, 3)) + y[:, None]
    df = spark.createDataFrame([(i, [float(v) for v in row], int(c)) for i, (row, c) in enumerate(zip(x, y))], "id bigint, features array<double>, label int")
    assert abs(K.silhouette(df.select("id", "features"), df.select("id", "label")).head()[0] - silhouette_score(x, y)) < 1e-9
    near = {a: b for a, b in K.neighbour_counts(df, 0.5).collect()}
    want = [int((((x - p) ** 2).sum(1) <= 0.25).sum()) for p in x[:50]]
    assert len(near) == n and [near[i] for i in range(50)] == want
    some = df.filter("id < 300")
    monkeypatch.setattr(K, "BLOCK", 7)
    assert abs(K.silhouette(some.select("id", "features"), some.select("id", "label")).head()[0] - silhouette_score(x[:300], y[:300])) < 1e-9


def test_robustness_sweeps_both_algorithms(spark, monkeypatch):
    import cohortloom.plans.model_plans as Q

    seen = []
    monkeypatch.setattr(Q.K, "robustness", lambda full, boots: seen.extend([full, boots]))
    Q.bootstrap_robustness(spark, "/root/testdata/sf0.001")
    want = {f"{a}_{k}" for a in ("kmedoids", "hierarchical") for k in range(2, 41)}
    assert {r[0] for r in seen[0].select("clustering_id").distinct().collect()} == want
    runs = {(r.boot_id, r.clustering_id): r["count"] for r in seen[1].groupBy("boot_id", "clustering_id").count().collect()}
    assert len(runs) == 10 * len(want) and {c for _, c in runs} == want


def test_robustness_of_hierarchical_clusters(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(v) for v in r.normal(size=2) + 20 * (i % 3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id bigint, features array<double>")
    members = spark.createDataFrame([(b, i) for b in range(2) for i in range(90) if (i // 3 + b) % 3], "boot_id int, id bigint")
    boots = K.sweep_boots(df, members, "hierarchical")
    assert boots.select("k").distinct().count() == 39
    got = K.robustness(K.sweep(df, "hierarchical", [3]), boots.filter("k = 3")).collect()
    assert got and all(x.is_robust and abs(x.actual - 1) < 1e-9 for x in got)


def test_trees_see_all_columns_and_the_grid(spark, monkeypatch):
    import cohortloom.plans.model_plans as Q

    r = np.random.default_rng(0)
    x = r.random((400, 40))
    rows = [(i, [float(v) for v in row], 0 if row[37] > 0.5 else 7) for i, row in enumerate(x)]
    monkeypatch.setattr(Q, "vectors", lambda spark, d: spark.createDataFrame(rows, "id bigint, features array<double>, label int"))
    asked = []
    real = P.DecisionTreeClassifier
    monkeypatch.setattr(P, "DecisionTreeClassifier", lambda **o: asked.append((o["maxDepth"], o["minInfoGain"])) or real(**o))
    got = Q.tree_explain(spark, "").collect()
    assert "feature 37" in got[0].rules and got[0].accuracy > 0.95
    assert {(d, 2.0**-g) for d in (6, 10) for g in range(4, 9)} <= set(asked)


def test_itemsets_of_every_kind_and_depth(spark):
    import cohortloom.plans.report_plans as Q

    got = {(r.kind, r.depth) for r in Q.itemset_analysis(spark, "/root/testdata/sf0.001").select("kind", "depth").distinct().collect()}
    assert got == {(k, n) for k in ("part", "diagnosis", "procedure") for n in (1, 2, 3)}
    rows = spark.createDataFrame([(1, "428.01"), (1, "E849.0"), (1, "V10.1")], "enc bigint, code string")
    c = {k: (v, l) for k, v, _, l in Q.code_levels(spark, "/root/testdata/sf0.001")}["diagnosis"]
    plain = rows.selectExpr("enc", "replace(code, '.', '') as code")
    assert {tuple(r) for r in plain.select(*[l.alias(f"d{n}") for n, l in enumerate(c[1])]).collect()} == {("428", "4280", "42801"), ("E849", "E8490", "E8490"), ("V10", "V101", "V101")}
