"""Queries over labelings and tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators import similarity as A
from cohortloom.operators import stats as X
from cohortloom.plans.registry import query
from cohortloom.plans.views import ENC, LAB2, enc, lab2


@query(f"with {LAB2} select a, b, count(*) as n from lab2 group by 1, 2")
def contingency(spark: SparkSession, d: str) -> DataFrame:
    return A.contingency(lab2(spark, d))


_ARI = """select round((sab - sa * sb / (t * (t - 1) / 2.0)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2.0)), 6) as ari from
  (select sum(n * (n - 1) / 2.0)::double as sab, sum(n)::double as t from tab), (select sum(n * (n - 1) / 2.0)::double as sa from (select sum(n) as n from tab group by a)), (select sum(n * (n - 1) / 2.0)::double as sb from (select sum(n) as n from tab group by b))"""
_JAC = """select round(least(ma, mb) / t, 6) as jaccard from (select sum(n)::double as t from tab), (select sum(m)::double as ma from (select max(n) as m from tab group by a)), (select sum(m)::double as mb from (select max(n) as m from tab group by b))"""
_TAB = f"{LAB2}, tab as (select a, b, count(*) as n from lab2 group by 1, 2)"


@query(f"with {_TAB} {_ARI}")
def rand_index(spark: SparkSession, d: str) -> DataFrame:
    return A.rand_index(A.contingency(lab2(spark, d))).select(F.round("ari", 6).alias("ari"))


@query(f"with {_TAB} {_JAC}")
def jaccard_agnostic(spark: SparkSession, d: str) -> DataFrame:
    return A.jaccard(A.contingency(lab2(spark, d))).select(F.round("jaccard", 6).alias("jaccard"))


@query(
    f"""with {_TAB}, r as (select a, sum(n)::double as x from tab group by a), c as (select b, sum(n)::double as y from tab group by b), t as (select sum(n)::double as t from tab),
h as (select (select -sum(x / t * ln(x / t)) from r, t) as ha, (select -sum(y / t * ln(y / t)) from c, t) as hb, (select sum(n / t * ln(n * t / (x * y))) from tab join r using (a) join c using (b), t) as mi),
em as (select sum(n / t * ln(t * n / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(t - x + 1) + lgamma(t - y + 1) - lgamma(t + 1) - lgamma(n + 1) - lgamma(x - n + 1) - lgamma(y - n + 1) - lgamma(t - x - y + n + 1))) as e
  from (select x, y, t, unnest(range(cast(greatest(1, x + y - t) as bigint), cast(least(x, y) as bigint) + 1))::double as n from r, c, t))
select round((mi - e) / ((ha + hb) / 2 - e), 6) as ami from h, em"""
)
def mutual_information_adjusted(spark: SparkSession, d: str) -> DataFrame:
    return A.mutual_information(A.contingency(lab2(spark, d))).select(F.round("ami", 6).alias("ami"))


def _long(spark: SparkSession, d: str) -> DataFrame:
    """Three labelings in long form: id, clustering_id, k, label."""
    l = lab2(spark, d)
    parts = [l.select("id", F.lit(c).alias("clustering_id"), F.lit(k).alias("k"), F.col(c).alias("label")) for c, k in (("a", 10), ("b", 7), ("c", 3))]
    return reduce(lambda x, y: x.unionByName(y), parts)


_LONG = f"{LAB2}, long as (select id, 'a' as clustering_id, 10 as k, a as label from lab2 union all select id, 'b', 7, b from lab2 union all select id, 'c', 3, c from lab2)"


@query(
    f"""with {_LONG}, n as (select clustering_id, label, count(*) as n from long group by 1, 2), p as (select *, n / sum(n) over (partition by clustering_id) as p from n)
select clustering_id, count(*) as k, round(exp(-sum(p * ln(p))), 6) as k_effective, count(*) < 2 as trivial, max(p) > 0.9 as pseudo_trivial from p group by 1"""
)
def effective_clusters(spark: SparkSession, d: str) -> DataFrame:
    return A.label_quality(_long(spark, d)).withColumn("k_effective", F.round("k_effective", 6))


@query(
    f"""with {_LONG}, n as (select x.clustering_id as child_id, x.label as child, y.clustering_id as parent_id, y.label as parent, count(*) as n from long x join long y on x.id = y.id and y.k < x.k group by all)
select *, round(n / sum(n) over (partition by child_id, child, parent_id), 6) as share from n"""
)
def lineage(spark: SparkSession, d: str) -> DataFrame:
    return A.lineage(_long(spark, d)).withColumn("share", F.round("share", 6))


@query(f"with {LAB2}, r as (select id, 0 as rank, c as label from lab2 union all select id, 1, b from lab2 union all select id, 2, a from lab2) select x.rank, x.label, y.label as next_label, count(*) as n from r x join r y on x.id = y.id and y.rank = x.rank + 1 group by all")
def alluvial_flow(spark: SparkSession, d: str) -> DataFrame:
    l = lab2(spark, d)
    parts = [l.select("id", F.lit(i).alias("rank"), F.col(c).alias("label")) for i, c in enumerate("cba")]
    return A.flow(reduce(lambda x, y: x.unionByName(y), parts))


def _run_scores(spark: SparkSession, d: str) -> DataFrame:
    l = _long(spark, d)
    return A.run_similarity(l.filter("clustering_id in ('a', 'b')"), l.filter("clustering_id in ('b', 'c')"))


_RUN = " union all ".join(
    f"select '{x}' as left_id, '{y}' as right_id, (select ari from (with tab as (select {x} as a, {y} as b, count(*) as n from lab2 group by 1, 2) {_ARI})) as ari, (select jaccard from (with tab as (select {x} as a, {y} as b, count(*) as n from lab2 group by 1, 2) {_JAC})) as jaccard"
    for x in "ab"
    for y in "bc"
).replace("select b as a, b as b", "select b as a, b as b")


@query(f"with {LAB2} {_RUN}")
def run_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _run_scores(spark, d).select("left_id", "right_id", F.round("ari", 6).alias("ari"), F.round("jaccard", 6).alias("jaccard"))


@query(f"with {LAB2}, s as ({_RUN}) select round(max(ari), 6) as high, round(min(ari), 6) as low, round(avg(ari), 6) as mean from s")
def run_similarity_summary(spark: SparkSession, d: str) -> DataFrame:
    s = _run_scores(spark, d).withColumn("ari", F.round("ari", 6))
    return s.agg(F.round(F.max("ari"), 6).alias("high"), F.round(F.min("ari"), 6).alias("low"), F.round(F.avg("ari"), 6).alias("mean"))


_RANKS = f"""{ENC}, r as (select lab, num, rank() over (order by num) + (count(*) over (partition by num) - 1) / 2.0::double as r from enc),
w as (select lab, sum(r)::double as w, count(*) as n_in from r group by lab), t as (select count(*) as n_all from enc)"""


@query(f"with {_RANKS} select lab, n_in, n_all - n_in as n_out, round((w - n_in * (n_all + 1) / 2.0::double) / sqrt(n_in * (n_all - n_in) * (n_all + 1) / 12.0::double), 6) as z from w, t")
def rank_sum(spark: SparkSession, d: str) -> DataFrame:
    return X.rank_sum(enc(spark, d), "lab", "num").withColumn("z", F.round("z", 6))


@query()
def rank_sum_p(spark: SparkSession, d: str) -> DataFrame:
    r = X.rank_sum(enc(spark, d), "lab", "num")
    return r.select("lab", F.coalesce(X.normal_two_sided("z"), F.lit(1.0)).alias("p_value"))


@query(f"with {ENC}, g as (select case when died then 1 else 0 end as g, num from enc where num is not null), m as (select avg(num) filter (g = 0) as m0, avg(num) filter (g = 1) as m1, var_samp(num) filter (g = 0) / count(*) filter (g = 0) as a, var_samp(num) filter (g = 1) / count(*) filter (g = 1) as b, count(*) filter (g = 0) as n0, count(*) filter (g = 1) as n1 from g) select round((m0 - m1) / sqrt(a + b), 6) as t, round((a + b) * (a + b) / (a * a / (n0 - 1) + b * b / (n1 - 1)), 4) as df from m")
def welch_test(spark: SparkSession, d: str) -> DataFrame:
    e = enc(spark, d).withColumn("g", F.col("died").cast("int"))
    return X.welch(e, "g", "num").select(F.round("t", 6).alias("t"), F.round("df", 4).alias("df"))
