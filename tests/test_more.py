import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import cohort as C
from cohortloom.operators import events as E
from cohortloom.operators import itemsets as I
from cohortloom.operators import search as H
from cohortloom.operators import similarity as A
from cohortloom.sources import readers as R
from cohortloom.sources import sinks as S
from cohortloom.streaming.incremental import keep_features


def test_stream_keeps_features(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "enc bigint, value double"
    mean = lambda df: df.groupBy("enc").agg(F.avg("value").alias("mean"))

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        keep_features(spark.readStream.schema(schema).parquet(src), mean, out, str(tmp_path / "cp")).awaitTermination()
        return {r.enc: r["mean"] for r in R.read_upserted(spark, out).collect()}

    assert add([(1, 2.0), (1, 4.0), (2, 5.0)]) == {1: 3.0, 2: 5.0}
    assert add([(2, 9.0), (3, 7.0)]) == {1: 3.0, 2: 5.0, 3: 7.0}


def test_permutations(spark):
    rows = [(i, ["a", "b"] if i % 2 else ["b"], i % 2) for i in range(60)]
    tx = spark.createDataFrame(rows, "enc bigint, items array<string>, lab int")
    sets = I.frequent(tx, 0.1)
    real = [r.p_value for r in I.p_values(I.enrichment(tx, sets, "lab")).collect()]
    null = [r.p_value for r in I.permutation_null(tx, sets, "lab", 2, 1).collect()]
    assert min(real) < 1e-10 and len(null) == 2 * len(real) and min(null) > min(real)


def test_search_helpers(spark):
    e = spark.createDataFrame([(1, 1, 5.0), (1, 2, 7.0), (1, 3, 4.0)], "run int, epoch int, objective double")
    assert [(r.best, r.is_best) for r in H.running_best(e).orderBy("epoch").collect()] == [(5.0, True), (5.0, False), (4.0, True)]
    p = H.pages(spark.range(10), "id", 4).orderBy("id").collect()
    assert [r.page for r in p] == [0] * 4 + [1] * 4 + [2] * 2
    runs = spark.createDataFrame([(i, "ab"[i % 2], float(i), 3.0 * i) for i in range(40)], "run int, kind string, x double, objective double")
    hot = H.one_hot_args(runs, ["kind"], {"kind": ["a", "b"]})
    assert hot.columns == ["run", "x", "objective", "kind=a", "kind=b"]
    pred = H.surrogate(runs, ["x"], runs.filter("run in (0, 39)")).orderBy("run").collect()
    assert pred[0].predicted < pred[1].predicted


def test_small_helpers(spark, tmp_path):
    s = spark.createDataFrame([("kmedoids_5", "rand", 0.1, 0.9)], "clustering_id string, metric string, threshold double, actual double")
    q = spark.createDataFrame([("kmedoids_5", 4.5)], "clustering_id string, k_effective double")
    r = A.robustness_by_option(s, q).head()
    assert (r.algorithm, r.option, r.k_effective) == ("kmedoids", 5, 4.5)
    l = spark.createDataFrame([(1, None, None, "hr"), (2, None, "time", "x"), (3, "bp", None, "x")], "item int, fused_label string, meta string, label string")
    assert [x.key for x in E.resolved_label(l).orderBy("item").collect()] == ["hr_1", "meta_time_2", "bp_3"]
    assert [x[0] for x in spark.range(1).select(E.overlap(F.lit(1), F.lit(5), F.lit(4), F.lit(9))).collect()] == [2]
    d = spark.createDataFrame([(1, "training", 0.5), (2, "validation", 3.0)], "enc int, split string, days_in_care double")
    assert C.in_split(d, "validation").count() == 1 and C.in_split(d, "bed_and_breakfast").count() == 1 and C.in_split(d, "all").count() == 2
    drawn = C.sample_with_replacement(spark.range(1000), "id", 1000, 3)
    assert drawn.count() == 1000 and 550 < drawn.select("id").distinct().count() < 700
    assert C.sample_with_replacement(spark.range(0), "id", 10, 3).count() == 0
    (tmp_path / "cci.csv").write_text("'title',,\n'CODE','NAME','CHRONIC'\n'0010 ','x','0'\n'0011 ','y','1'\n")
    assert {x.code: x.chronic for x in R.chronic_codes(spark, str(tmp_path / "cci.csv")).collect()} == {"0010": False, "0011": True}
    S.support_statistics(spark.createDataFrame([("a", 0.2), ("b", 0.9)], "item string, support double"), str(tmp_path / "s"))
    S.projection_json(spark.createDataFrame([(1, 2, [0.1, 0.2, 0.3])], "id int, label int, features array<double>"), str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).head().z == 0.3


def test_trees_of_selections_and_classifiers(spark):
    """The selection that holds the rule finds it; missing cells are a value of their own."""
    import random

    from cohortloom.operators import features as P

    r = random.Random(1)
    rows = []
    for i in range(600):
        a, b = r.random(), r.random()
        rows.append((i, int(a > 0.5), [None if a > 0.5 and i % 3 == 0 else a], [b, r.random()]))
    df = spark.createDataFrame(rows, "id bigint, y int, told array<double>, noise array<double>")
    got = P.tree_selections(df, "y", {"told": ["told"], "noise": ["noise"], "both": ["noise", "told"]}, depths=(4,), gains=(2**-4,)).collect()
    assert {x.selection for x in got} == {"told", "both"} and all(x.accuracy > 0.99 for x in got)
    x = spark.createDataFrame([(i, [float(y), r.gauss(0, 1)], y, 1, int(r.random() < 0.5)) for i, y in ((i, i % 2) for i in range(300))], "id bigint, features array<double>, sure int, one int, chance int")
    c = {q.target: q for q in P.classify_each(x, x, ["sure", "one", "chance"]).collect()}
    assert set(c) == {"sure", "chance"} and c["sure"].f1 > 0.99 and c["chance"].auc < 0.7


@pytest.mark.parametrize("long", [1 << 17, 20])
def test_quantiles_are_exact(spark, monkeypatch, long):
    import numpy as np

    from cohortloom.functions import spread
    from cohortloom.functions.quantiles import quantiles

    monkeypatch.setattr(spread, "LONG", long)
    r = np.random.default_rng(2)
    rows = [(g, None if r.random() < 0.1 else float(np.round(r.normal() * 10 ** (g % 3), 1))) for g in (1, 2, 3) for _ in range(400)] + [(4, None), (5, 7.0)]
    df = spark.createDataFrame(rows, "g int, x double")
    levels = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    got = {x.g: x.q for x in quantiles(df, "x", levels, ["g"]).collect()}
    for g in (1, 2, 3, 5):
        assert np.allclose(got[g], np.quantile([x for k, x in rows if k == g and x is not None], levels))
    assert 4 not in got
    assert np.allclose(quantiles(df, "x", levels).head().q, np.quantile([x for _, x in rows if x is not None], levels))
    assert quantiles(df.filter("g = 4"), "x", levels).count() == 0 or quantiles(df.filter("g = 4"), "x", levels).head().q in (None, [])


def test_many_pieces(spark, monkeypatch):
    """Two levels of cuts, as on clusters with many cores."""
    from cohortloom.functions import spread

    df = spark.createDataFrame([(i % 3 or None, float(i * 7 % 501), i % 5, i if i % 4 else None) for i in range(1500)], "g int, t double, one int, i int")

    def both():
        total = {tuple(x) for x in spread.running_total(df, "t", {"one": "below"}, ["g"], ["i"]).collect()}
        near = {tuple(x) for x in spread.neighbours(df.na.drop(), ["g"], ["t", "i"], ["i"], F.col("i") % 3 == 0, "b", "a", current=False).collect()}
        alone = {tuple(x) for x in spread.running_total(df, "t", {"one": "below"}, None, ["g", "i"]).collect()}
        return total, near, alone

    want = both()  # plain windows
    assert len(want[0]) > 900 and len(want[1]) > 500
    monkeypatch.setattr(spread, "LONG", 10)
    assert both() == want  # pieces
    monkeypatch.setattr(spread, "PIECES", 2)
    assert both() == want  # pieces by two levels of cuts


def test_registry_of_measures(spark, monkeypatch):
    """Robustness reads the registry."""
    from cohortloom.operators import similarity as A

    t = spark.createDataFrame([("c", 1, 1, 5), ("c", 2, 2, 5), ("c", 1, 2, 1)], "k string, a int, b int, n bigint")
    monkeypatch.setitem(A.MEASURES, "largest", lambda cells: float(max(n for _, _, n in cells)))
    got = {r.metric: r.score for r in A.all_measures(t, ["k"]).collect()}
    assert set(got) == {"mutual_info", "rand", "jaccard", "largest"} and got["largest"] == 5.0
    assert abs(got["rand"] - A.rand_index(t).head()[0]) < 1e-12 and abs(got["jaccard"] - A.jaccard(t).head()[0]) < 1e-12 and abs(got["mutual_info"] - A.mutual_information(t).head()[0]) < 1e-12


def test_fisher_against_all_tables():
    import math
    import random

    from cohortloom.operators.stats import fisher_exact

    def brute(a, b, c, d):
        lp = lambda x: math.log(math.comb(a + b, x)) + math.log(math.comb(c + d, a + c - x))
        all_ = [lp(x) for x in range(max(0, a - d), min(a + b, a + c) + 1)]
        total = sum(map(math.exp, all_))
        return min(1.0, sum(math.exp(p) for p in all_ if p <= lp(a) + 1e-7) / total)

    r = random.Random(1)
    for _ in range(400):
        t = [r.randint(0, r.choice([2, 15, 90])) for _ in range(4)]
        assert abs(fisher_exact(*t) - brute(*t)) < 1e-9
    assert fisher_exact(10**7, 10**7, 10**7, 10**7) == 1.0 and abs(fisher_exact(10**6 + 3000, 10**6, 10**6, 10**6) - math.erfc(1.5 / 2**0.5)) < 0.001


def test_likelihood_of_components(spark):
    """Equal to the density of the normal distribution that the components describe."""
    import numpy as np

    from cohortloom.operators.features import Components

    r = np.random.default_rng(3)
    x = r.normal(size=(300, 4)) @ np.diag([5.0, 3.0, 0.5, 0.5])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, features array<double>")
    got = Components(2).fit(df).log_likelihood(df).head()[0]
    s = np.cov(x.T)
    vals, vecs = np.linalg.eigh(s)
    vals[:2] = vals[:2].mean()
    c = vecs @ np.diag(vals) @ vecs.T
    z = x - x.mean(0)
    want = np.mean([-0.5 * (4 * np.log(2 * np.pi) + np.linalg.slogdet(c)[1] + v @ np.linalg.solve(c, v)) for v in z])
    assert abs(got - want) < 1e-6


def test_options_of_a_part():
    from cohortloom.operators.chart import ChartParams

    p = H.options(ChartParams, {"limit": "7.5", "frozen": "9"})
    assert (p.limit, p.frozen, p.longest) == (7.5, 9, 3)
    with pytest.raises(ValueError, match="limits"):
        H.options(ChartParams, {"limits": "1"})


def dense(spark, seed=4):
    """300 transactions of up to 9 of 12 items, some unlabelled: rows of (enc, item) and labels, and both by encounter."""
    r = np.random.default_rng(seed)
    held = {i: sorted(f"i{x}" for x in r.choice(12, r.integers(1, 10), replace=False)) for i in range(300)}
    labels = {i: None if i % 11 == 0 else "ab"[i % 2] for i in held}
    codes = spark.createDataFrame([(i, x) for i, items in held.items() for x in items for _ in range(2)], "enc bigint, code string")
    return held, labels, codes, spark.createDataFrame(list(labels.items()), "enc bigint, lab string")


def brute_maximal(held, support):
    from itertools import combinations

    least = math.ceil(support * len(held))
    n = Counter(s for items in held.values() for k in range(1, len(items) + 1) for s in combinations(items, k))
    sets = {s for s, m in n.items() if m >= least}
    return sets - {s[:i] + s[i + 1 :] for s in sets for i in range(len(s))}


@pytest.mark.parametrize("one_pass,most", [(20_000, 200_000), (1, 200_000), (20_000, 1)])
def test_maximal_sets_inside_labels(spark, monkeypatch, one_pass, most):
    """All sizes in one pass, a size in each, and the library's mining beyond the limit: the same counts."""
    monkeypatch.setattr(I, "PASS", one_pass)
    monkeypatch.setattr(I, "MOST", most)
    held, labels, codes, lab = dense(spark)
    tx = I.transactions(codes.withColumnRenamed("code", "item")).join(lab, "enc")
    for support in (0.03, 0.2, 0.9):
        want = {(x, s): m for s in brute_maximal(held, support) for x in (None, "a", "b") if (m := sum(set(s) <= set(held[i]) for i in held if labels[i] == x))}
        got = [((r.lab, tuple(r.itemset)), r.n) for r in I.maximal_inside(tx, 300, support, "lab").collect()]
        assert len(got) == len(want) and dict(got) == want


def test_itemset_analysis_counts_without_trees(spark, monkeypatch):
    """The analysis neither builds trees of all transactions nor shuffles a row for each set that a transaction holds."""
    import cohortloom.plans.report_plans as Q

    held, labels, codes, lab = dense(spark)
    monkeypatch.setattr(I, "FPGrowth", None)
    monkeypatch.setattr(I, "support_counts", None)
    monkeypatch.setattr(Q, "code_levels", lambda spark, d: [("part", codes, lab.na.drop(), [F.col("code"), F.lit(None).cast("string")])])
    got = Q.itemset_analysis(spark, "").collect()
    known = {i: items for i, items in held.items() if labels[i]}
    sets = brute_maximal(known, 0.02)
    assert {r.depth for r in got} == {1} and len(got) == 2 * len(sets)
    share = lambda s, x: sum(set(s) <= set(known[i]) for i in known if labels[i] == x) / sum(labels[i] == x for i in known)
    want = {(x, s[0] if len(s) == 1 else f"({len(s)}) [{', '.join(s)}]"): share(s, x) for s in sets for x in "ab"}
    assert {(r.lab, r.itemset): r.support for r in got} == pytest.approx(want)
