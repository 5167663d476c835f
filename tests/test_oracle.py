"""Every query of the core beside its SQL, on the smallest tables."""

import duckdb
import pytest

from cohortloom.plans import agreement_plans, events_plans, fitted_plans, model_plans, registry, report_plans, rule_plans, source_plans, static_plans, training_data  # noqa: F401
from compare import canonical, views

QUERIES = {**registry.QUERIES, **training_data.QUERIES}
ORACLE = {**registry.ORACLE, **training_data.ORACLE}
SMALL = "/root/testdata/sf0.001"
#: Many small jobs; they have tests of their own.
SLOW = {"bootstrap_robustness", "tree_explain", "kmeans_sweep", "tree_selections", "category_classifiers", "cluster_analysis"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    views(c, SMALL)
    return c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, con, name):
    left = QUERIES[name](spark, SMALL).toPandas()
    if name in ORACLE:
        right = con.execute(ORACLE[name]).df()
        assert sorted(left.columns) == sorted(right.columns)
        a, b = canonical(left), canonical(right)
        assert len(a) == len(b) and a.equals(b)
    else:
        assert len(left) and name in WANTED
        WANTED[name](left)


def shares(*columns):
    def check(t):
        for c in columns:
            assert t[c].between(0, 1).all()

    return check


def whole_labels(t):
    """Every clustering labels every point, with at most as many labels as it was asked for."""
    for _, g in t.groupby("clustering_id"):
        assert len(g) == g["id"].nunique() == 500


def quantiles_are_normal(t):
    assert (t["value"].dropna().quantile([0.25, 0.5, 0.75]) - [-0.6745, 0, 0.6745]).abs().max() < 0.1


def standardised(t):
    z = t["value"].dropna()
    assert abs(z.mean()) < 0.1 and abs(z.std() - 1) < 0.1


def likelihood(t):
    x = t.set_index("split")["log_likelihood"]
    assert x["training"] >= x["validation"] - 5


#: What must hold of the queries that have no SQL.
WANTED = {
    "age_survival_fit": lambda t: None if len(t) == 10 and t["survival"].between(-0.5, 1.5).all() else pytest.fail("fit"),
    "density_clusters": whole_labels,
    "hierarchical": whole_labels,
    "kmedoids": whole_labels,
    "error_variance_test": shares("p_value"),
    "feature_classifier": shares("precision", "recall", "f1", "auc"),
    "itemset_analysis": shares("support", "p_value"),
    "metric_sensitivity": lambda t: None if (t[t["share"] == 0]["score"] - 1).abs().max() < 1e-9 and t["score"].max() <= 1 + 1e-9 else pytest.fail("agreement"),
    "mortality_interval": lambda t: shares("mortality")(t) if (t["half_width"].dropna() >= 1.96 * t["se"][t["half_width"].notna()] * 0.999).all() else pytest.fail("half width"),
    "p2_found": lambda t: None if set(t["unit"]) <= {"kg", "lb", "oz", "g"} and t["row_id"].is_unique else pytest.fail("units"),
    "p2_weights": lambda t: None if (t["kg"] > 0).all() and t["row_id"].is_unique else pytest.fail("weights"),
    "p5_series": lambda t: None if t[t["state"] == "marked"]["x"].isna().all() and t[t["state"] != "marked"]["x"].notna().all() else pytest.fail("states"),
    "p6_flags": lambda t: None if set(t["reason"]) <= {"impossible", "spike", "frozen"} and t["row_id"].is_unique else pytest.fail("reasons"),
    "p6_found": lambda t: None if t["row_id"].is_unique else pytest.fail("rows"),
    "pca_explained": lambda t: shares("explained", "cumulative")(t.assign(cumulative=t["cumulative"].clip(upper=1))) if t["explained"].is_monotonic_decreasing else pytest.fail("order"),
    "pca_features": lambda t: None if t["id"].is_unique and set(map(len, t["features"])) == {16} else pytest.fail("size"),
    "pca_likelihood": likelihood,
    "pca_reconstruction": lambda t: None if (t["mse"] >= 0).all() and t["id"].is_unique else pytest.fail("errors"),
    "rank_sum_p": shares("p_value"),
    "sampled_settings": lambda t: None if len(t) == 150 and t.groupby("run").size().eq(3).all() else pytest.fail("settings"),
    "scale_power": standardised,
    "scale_quantile_normal": quantiles_are_normal,
}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
