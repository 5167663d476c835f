"""Queries over fitted scalers, fusion and reconstruction errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.spread import settled
from cohortloom.operators import fusion as M
from cohortloom.operators import recon as R
from cohortloom.operators import scaling as Z
from cohortloom.operators import series as S
from cohortloom.plans.events_plans import _GRID, grid
from cohortloom.plans.registry import query
from cohortloom.plans.views import EV, MIN, ev, minutes
from cohortloom.sources.tables import table

#: Training encounters: a fixed share of the key space, the same rule in both engines.
_TRAIN = "enc % 10 < 9"
_T = f"{EV}, train as (select item, value from ev where {_TRAIN} and value is not null)"


def _train(spark: SparkSession, d: str) -> DataFrame:
    return ev(spark, d).filter(_TRAIN).filter("value is not null").select("item", "value")


def _scaled(spark: SparkSession, d: str, mode: str) -> DataFrame:
    s = Z.SCALERS[mode]()
    return s.transform(ev(spark, d).select("event_id", "item", "value"), s.fit(_train(spark, d))).select("event_id", "item", F.round("value", 6).alias("value"))


@query(f"with {_T}, p as (select item, min(value) as a, max(value) - min(value) as s from train group by item) select event_id, item, round((value - a) / case when s > 0 then s else 1 end, 6) as value from ev join p using (item)")
def scale_minmax(spark: SparkSession, d: str) -> DataFrame:
    return _scaled(spark, d, "minmax")


@query(f"with {_T}, p as (select item, avg(value) as a, stddev_pop(value) as s from train group by item) select event_id, item, round((value - a) / case when s > 0 then s else 1 end, 6) as value from ev join p using (item)")
def scale_standard(spark: SparkSession, d: str) -> DataFrame:
    return _scaled(spark, d, "standard")


@query(
    f"""with {_T}, p as (select item, quantile_cont(value, 0.5) as a, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as s from train group by item)
select event_id, item, round((value - a) / case when s > 0 then s else 1 end, 6) as value from ev join p using (item)"""
)
def scale_robust(spark: SparkSession, d: str) -> DataFrame:
    return _scaled(spark, d, "robust")


@query()
def scale_quantile_normal(spark: SparkSession, d: str) -> DataFrame:
    return _scaled(spark, d, "quantile")


@query()
def scale_power(spark: SparkSession, d: str) -> DataFrame:
    return _scaled(spark, d, "power")


@query(f"with {EV} select event_id, item, round(value, 6) as value from ev")
def scale_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    s = Z.Standard()
    fitted = s.fit(_train(spark, d))
    e = ev(spark, d).select("event_id", "item", "value")
    return s.inverse(s.transform(e, fitted), fitted).select("event_id", "item", F.round("value", 6).alias("value"))


@query(f"with {_T}, p as (select item, min(value) as a, max(value) - min(value) as s from train group by item) select round(max((value - a) / case when s > 0 then s else 1 end) + 1, 0) as mask_value from ev join p using (item)")
def mask_value(spark: SparkSession, d: str) -> DataFrame:
    s = Z.MinMax()
    return Z.mask_value(s.transform(ev(spark, d).select("item", "value"), s.fit(_train(spark, d))))


@query(
    f"""with {_GRID}, med as (select item, quantile_cont(value, 0.5) as median from interp where {_TRAIN} group by item)
select enc, item, t, round(coalesce(value, median), 6) as value from interp join med using (item)"""
)
def train_median_fill(spark: SparkSession, d: str) -> DataFrame:
    filled = settled(S.interpolate(grid(spark, d)))  # read for the medians and for the result
    return Z.fill_medians(filled, Z.medians(filled.filter(_TRAIN))).select("enc", "item", "t", F.round("value", 6).alias("value"))


@query("select c_custkey, coalesce(case when c_acctbal > 0 then c_acctbal end, s2) as x from customer, (select cast(floor(least(min(case when c_acctbal > 0 then c_acctbal end), min(c_nationkey)) - 1) as double) as s2 from customer)")
def sentinel_fill(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("x"), F.col("c_nationkey").cast("double").alias("k"))
    return Z.sentinel_fill(c, ["x", "k"]).select("c_custkey", "x")


@query("with p as (select avg(c_acctbal) as m, stddev_pop(c_acctbal) as s from customer) select c_custkey, round((c_acctbal - m) / s, 6) as x from customer, p")
def feature_normalisation(spark: SparkSession, d: str) -> DataFrame:
    return Z.normalise(table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("x")), ["x"]).select("c_custkey", F.round("x", 6).alias("x"))


_RULES = [("click", "visit", 0, "visit_click_view"), ("view", "visit", 1, "visit_click_view"), ("error", "other", 0, "other_error_signup"), ("signup", "other", 1, "other_error_signup")]
_RULES_SQL = ", ".join(f"('{i}', {p}, '{n}')" for i, _, p, n in _RULES)


@query(
    f"""with {EV}, chart as (select enc, item, epoch_us(date_trunc('day', ts)) // 60000000 as t, avg(value) as value from ev group by 1, 2, 3),
rules(item, pos, name) as (values {_RULES_SQL}),
r as (select *, dense_rank() over (partition by enc order by t) - 1 as r from chart),
cells as (select r.*, rules.pos, rules.name from r join rules using (item) where value is not null),
cols as (select enc, name, item, pos, count(*) as n, min(r) as lo, max(r) as hi, avg(r) as mean_r, list(r order by r) as rs, list(value order by r) as vs from cells group by all),
gr as (select enc, name, count(*) as k, max(n) as most, greatest(0, min(hi) - max(lo) + 1) as overlap, count(distinct rs) as patterns, count(distinct vs) as contents,
  arg_min(pos, mean_r * 1000 + pos) as early_pos, arg_min(pos, -n * 1000 + pos) as large_pos from cols group by all),
ch as (select *, case when k = 1 then 'only' when patterns = 1 or overlap < 0.1 * most then 'mean' when contents = 1 then 'early' else 'large' end as choice from gr)
select c.enc, c.name, c.t, round(avg(c.value), 6) as value from cells c join ch using (enc, name)
where choice in ('only', 'mean') or (choice = 'early' and pos = early_pos) or (choice = 'large' and pos = large_pos) group by 1, 2, 3"""
)
def fuse_columns(spark: SparkSession, d: str) -> DataFrame:
    t = F.floor(F.unix_micros(F.date_trunc("day", "ts").cast("timestamp")) / 60_000_000).cast("long")
    chart = ev(spark, d).groupBy("enc", "item", t.alias("t")).agg(F.avg("value").alias("value"))
    rules = spark.createDataFrame(_RULES, "item string, label string, pos int, name string")
    return M.fuse(chart, rules).withColumn("value", F.round("value", 6))


@query(
    """with x as (select label, list(distinct itemid order by itemid) as items from d_items group by label union all select category, list(distinct itemid order by itemid) from d_items group by category)
select label, array_to_string(items, ',') as items from x where len(items) >= 2"""
)
def label_collisions(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "d_items")
    both = i.select("label", F.col("itemid").alias("item")).union(i.select("category", "itemid"))
    return M.collisions(both).select("label", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


_PAIRS = f"""{MIN}, pts as (select enc, item, t, value from mins),
pairs as (select *, avg(value) over (partition by enc, item) as rec from pts),
errs as (select enc, item, count(*) as n, avg((value - rec) * (value - rec)) as mse, var_pop(value) as variance from pairs group by 1, 2)"""


def _r(c: str):
    """Six digits; values that lie in the middle between two of them are pushed up in both engines."""
    return F.round(F.col(c) + 1e-9, 6).alias(c)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return R.series_mean_reconstruction(minutes(spark, d).select("enc", "item", "t", "value"))


@query(f"with {_PAIRS} select enc, item, n, round(mse + 1e-9, 6) as mse, round(variance + 1e-9, 6) as variance from errs")
def reconstruction_error(spark: SparkSession, d: str) -> DataFrame:
    return R.series_errors(_pairs(spark, d)).select("enc", "item", "n", _r("mse"), _r("variance"))


@query(f"with {_PAIRS} select enc, round(sum(n * mse) / sum(n), 6) as error, cast(sum(n) as bigint) as n from errs group by enc")
def encounter_error(spark: SparkSession, d: str) -> DataFrame:
    return R.encounter_errors(R.series_errors(_pairs(spark, d))).select("enc", F.round("error", 6).alias("error"), "n")


@query(
    f"""with {_PAIRS} select item, round(quantile_cont(mse, 0.5), 6) as median, round(quantile_cont(mse, 0.25), 6) as p25, round(quantile_cont(mse, 0.75), 6) as p75, round(avg(mse), 6) as mean, round(stddev_pop(mse), 6) as sd, round(min(mse), 6) as low, round(max(mse), 6) as high, count(mse) as n
from errs group by rollup (item)"""
)
def error_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = R.stats(R.series_errors(_pairs(spark, d)), ["item"], "mse")
    return s.select("item", *[F.round(c, 6).alias(c) for c in ("median", "p25", "p75", "mean", "sd", "low", "high")], "n")


@query(f"with {_PAIRS} select enc, item, round(avg(case when value <> 0 and rec <> 0 then abs((value - rec) / value) end), 6) as mape from pairs group by 1, 2")
def mape(spark: SparkSession, d: str) -> DataFrame:
    return R.mape(_pairs(spark, d)).withColumn("mape", F.round("mape", 6))


@query(f"with {_PAIRS}, q as (select unnest(range(201)) as i) select i * 0.5::double as level, round(list_extract((select quantile_cont(mse, [{', '.join(str(i / 200) for i in range(201))}]) from errs), cast(i + 1 as int)), 6) as x from q")
def error_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return R.percentile_ladder(R.series_errors(_pairs(spark, d)), "mse").withColumn("x", F.round("x", 6))


@query(
    f"""with {_PAIRS}, t as ({' union all '.join(f"select {s}::double as share, quantile_cont(mse, {1 - s / 100}) as threshold from errs" for s in (0.1, 1.0, 5.0, 10.0))})
select share, round(threshold + 1e-9, 6) as threshold, round(avg(mse) + 1e-9, 6) as mean, count(*) as n from t, errs where mse <= threshold group by share, threshold"""
)
def worst_left_out(spark: SparkSession, d: str) -> DataFrame:
    w = R.worst_left_out(R.series_errors(_pairs(spark, d)), "mse", [0.1, 1.0, 5.0, 10.0])
    return w.select("share", _r("threshold"), _r("mean"), "n")


@query(f"with {_PAIRS} select round(50.0::double * (count(*) filter (mse < 800) + count(*) filter (mse <= 800) + case when count(*) filter (mse <= 800) > count(*) filter (mse < 800) then 1 else 0 end) / count(mse), 6) as percentile from errs")
def percentile_of_score(spark: SparkSession, d: str) -> DataFrame:
    return R.percentile_of_score(R.series_errors(_pairs(spark, d)), "mse", 800.0).withColumn("percentile", F.round("percentile", 6))


@query(f"with {_PAIRS} select round(corr(variance, n), 6) as r, count(*) as n from errs")
def error_variance_corr(spark: SparkSession, d: str) -> DataFrame:
    return R.series_errors(_pairs(spark, d)).agg(F.round(F.corr("variance", "n"), 6).alias("r"), F.count("*").alias("n"))


@query(f"with {_PAIRS} select item, cast(sum(n) as bigint) as n, round(quantile_cont(mse, 0.5), 6) as median from errs group by item")
def error_by_data_amount(spark: SparkSession, d: str) -> DataFrame:
    return R.series_errors(_pairs(spark, d)).groupBy("item").agg(F.sum("n").alias("n"), F.round(F.percentile("mse", F.lit(0.5)), 6).alias("median"))


@query(f"with {_PAIRS} select enc, item, t, value, round(rec, 6) as rec from pairs")
def observed_vs_reconstructed(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).withColumn("rec", F.round("rec", 6))


@query(
    f"""with {_PAIRS}, c as (select enc, count(*) as n from pts group by enc)
select count(*) as encounters, round(avg(n), 6) as mean, round(quantile_cont(n, 0.5), 6) as median, round(stddev_pop(n), 6) as sd, min(n) as low, max(n) as high from c"""
)
def observation_counts(spark: SparkSession, d: str) -> DataFrame:
    c = minutes(spark, d).groupBy("enc").agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("encounters"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.percentile("n", F.lit(0.5)), 6).alias("median"), F.round(F.stddev_pop("n"), 6).alias("sd"), F.min("n").alias("low"), F.max("n").alias("high"))
