"""Queries over event logs and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.operators import events as E
from cohortloom.operators import series as S
from cohortloom.operators import support as U
from cohortloom.plans.registry import query
from cohortloom.plans.views import ADM, EV, EVD, MIN, adm, ev, evd, minutes
from cohortloom.sources.tables import table

def _types(spark: SparkSession, d: str) -> list[str]:
    """The item list: a dictionary of a few values, refused beyond 1000."""
    rows = ev(spark, d).select("item").na.drop().distinct().orderBy("item").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("too many items for one pivot")
    return [r[0] for r in rows]


@query(f"pivot (with {EV} select enc, date_trunc('hour', ts) as ts, item, value from ev) on item using round(avg(value), 6) group by enc, ts")
def event_pivot_mean(spark: SparkSession, d: str) -> DataFrame:
    items = _types(spark, d)
    hourly = ev(spark, d).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return E.pivot_mean(hourly, items).select("enc", "ts", *[F.round(t, 6).alias(t) for t in items])


@query(f"""with {EVD} select enc, item, ts, round(coalesce(avg(value) filter (trusted), avg(value) filter (not trusted)), 6) as value from evd where value is not null group by 1, 2, 3""")
def trusted_override(spark: SparkSession, d: str) -> DataFrame:
    return E.trusted_override(E.drop_missing(evd(spark, d))).withColumn("value", F.round("value", 6))


@query(f"""with {EVD} select enc, item, ts, round(avg(value), 6) as value from evd where trusted group by 1, 2, 3""")
def source_means(spark: SparkSession, d: str) -> DataFrame:
    return E.mean_per_key(evd(spark, d).filter("trusted")).withColumn("value", F.round("value", 6))


@query(f"with {MIN} select enc, item, t, value from mins")
def minutes_since_admission(spark: SparkSession, d: str) -> DataFrame:
    return minutes(spark, d).drop("event_id")


@query(
    """select user_id as enc, event_type as item, ts, value, 'a' as unit from events where event_type in ('click', 'view') and value is not null
union select user_id, event_type, ts, value, 'a' from events where event_type in ('view', 'purchase') and value > 10"""
)
def medication_union(spark: SparkSession, d: str) -> DataFrame:
    e = ev(spark, d).select("enc", "item", "ts", "value", F.lit("a").alias("unit"))
    return E.union_distinct([e.filter("item in ('click', 'view') and value is not null"), e.filter("item in ('view', 'purchase') and value > 10")])


@query(
    """with items as (select distinct l_partkey as item from lineitem union select distinct l_suppkey + 1000000 from lineitem),
a as (select p_partkey as item, p_name as label from part where p_size > 10),
b as (select p_partkey as item, p_brand as label from part union all select s_suppkey + 1000000, s_name from supplier where s_acctbal > 0)
select i.item, coalesce(a.label, b.label, 'unknown_item_label_for_id_' || i.item) as label from items i left join a using (item) left join b using (item)"""
)
def item_label_lookup(spark: SparkSession, d: str) -> DataFrame:
    li, p, s = table(spark, d, "lineitem"), table(spark, d, "part"), table(spark, d, "supplier")
    items = li.select(F.col("l_partkey").alias("item")).union(li.select(F.col("l_suppkey") + 1_000_000)).distinct()
    first = p.filter("p_size > 10").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("label"))
    second = p.select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("label")).union(s.filter("s_acctbal > 0").select(F.col("s_suppkey") + 1_000_000, "s_name"))
    return E.item_labels(items, first, second)


@query(
    """with used as (select distinct itemid from chartevents)
select u.itemid as item, coalesce(d.label, 'unknown_item_label_for_id_' || u.itemid) as label from used u left join d_items d using (itemid)"""
)
def charted_item_labels(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "chartevents").select(F.col("itemid").alias("item")).distinct()
    first = table(spark, d, "d_items").select(F.col("itemid").alias("item"), "label")
    return E.item_labels(items, first, first.limit(0))


@query(
    f"""with {EVD}, f as (select enc, item, ts, max(value) as value from evd where trusted group by 1, 2, 3), s as (select enc, item, ts, max(value) as value from evd where not trusted group by 1, 2, 3)
select enc, item, ts, coalesce(f.value, s.value) as value from f full join s using (enc, item, ts)"""
)
def combine_first(spark: SparkSession, d: str) -> DataFrame:
    e = evd(spark, d)
    return E.combine_first(e.filter("trusted"), e.filter("not trusted"), ["enc", "item", "ts"])


@query(
    f"""with {EVD}, a as (select enc, epoch_us(ts) // 60000000 as t, round(avg(value) filter (item = 'click'), 6) as click, round(avg(value) filter (item = 'view'), 6) as view from evd group by 1, 2),
b as (select enc, epoch_us(ts) // 60000000 as t, round(avg(value) filter (item = 'error'), 6) as error, round(avg(value) filter (item = 'signup'), 6) as signup from evd group by 1, 2)
select enc, t, click, cast(null as double) as error, view from a union all select enc, t, null, error, null from b"""
)
def align_columns(spark: SparkSession, d: str) -> DataFrame:
    e = evd(spark, d).withColumn("t", F.floor(E.micros("ts") / 60_000_000).cast("long"))
    a = E.pivot_mean(e, ["click", "view"], "t").withColumns({c: F.round(c, 6) for c in ("click", "view")})
    b = E.pivot_mean(e, ["error", "signup"], "t").withColumns({c: F.round(c, 6) for c in ("error", "signup")})
    return E.align([a, b], ["click", "error", "view"])


@query(
    f"""with {EV}, big as (select * from ev where value > 80), total as (select count(distinct enc) as n from big)
select item, count(distinct enc) as n_enc, round(count(distinct enc) / cast(any_value(n) as double), 6) as support from big cross join total group by item"""
)
def column_support(spark: SparkSession, d: str) -> DataFrame:
    return U.relative_support(ev(spark, d).filter("value > 80")).withColumn("support", F.round("support", 6))


@query(
    f"""with {EV}, big as (select * from ev where value > 80), good as (select item from big group by item having count(distinct enc) >= 0.5 * (select count(distinct enc) from big))
select item, count(*) as n, round(sum(value), 4) as total from big where item in (select item from good) group by item"""
)
def well_supported_events(spark: SparkSession, d: str) -> DataFrame:
    return U.well_supported(ev(spark, d).filter("value > 80"), 0.5).groupBy("item").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    """with long as (select 'qty' as item, l_quantity as value from lineitem union all select 'one', 1.0::double from lineitem union all select 'none', null::double from lineitem union all select 'tax', l_tax from lineitem)
select item from long group by item having count(distinct value) <= 1"""
)
def constant_columns(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").selectExpr("stack(4, 'qty', l_quantity, 'one', 1.0D, 'none', cast(null as double), 'tax', l_tax) as (item, value)")
    return U.constant_items(li)


_GRID = f"""{MIN}, points as (select enc, item, t, avg(value) as value from mins group by 1, 2, 3),
grid as (select g.enc, i.item, g.t, p.value from (select distinct enc, t from mins) g join (select distinct enc, item from mins) i using (enc) left join points p on p.enc = g.enc and p.item = i.item and p.t = g.t),
filled as (select *,
  last_value(case when value is not null then t end ignore nulls) over w1 as b_t, last_value(value ignore nulls) over w1 as b_v,
  first_value(case when value is not null then t end ignore nulls) over w2 as a_t, first_value(value ignore nulls) over w2 as a_v from grid
  window w1 as (partition by enc, item order by t rows between unbounded preceding and current row), w2 as (partition by enc, item order by t rows between current row and unbounded following)),
interp as (select enc, item, t, value is not null as is_observed, case when value is not null then value when b_t is null then null when a_t is null then b_v else b_v + (a_v - b_v) * (t - b_t) / (a_t - b_t) end as value from filled)"""


def grid(spark: SparkSession, d: str) -> DataFrame:
    """All times of an encounter for each of its items, values null where an item has none at that time."""
    m = minutes(spark, d)
    points = m.groupBy("enc", "item", "t").agg(F.avg("value").alias("value"))
    return m.select("enc", "t").distinct().join(m.select("enc", "item").distinct(), "enc").join(points, ["enc", "item", "t"], "left")


@query(f"with {_GRID} select enc, item, t, is_observed, round(value, 6) as value from interp")
def interpolate_time(spark: SparkSession, d: str) -> DataFrame:
    return S.interpolate(grid(spark, d)).select("enc", "item", "t", "is_observed", F.round("value", 6).alias("value"))


@query(f"with {_GRID} select enc, item, t, case when is_observed then round(value, 6) end as value from interp")
def deimputed_values(spark: SparkSession, d: str) -> DataFrame:
    return S.deimpute(S.interpolate(grid(spark, d))).select("enc", "item", "t", F.round("value", 6).alias("value"))


@query(
    f"""with {MIN}, s as (select *, lag(value) over w as pv, lag(t) over w as pt, row_number() over w as n from mins window w as (partition by enc, item order by t, event_id))
select enc, item, event_id, (value - pv) / nullif(t - pt, 0) as delta from s where n > 1"""
)
def step_delta(spark: SparkSession, d: str) -> DataFrame:
    return S.step_delta(minutes(spark, d), ("t", "event_id")).select("enc", "item", "event_id", "delta")


@query(
    f"""with {MIN}, r as (select enc, item, value, cast(t - min(t) over (partition by enc, item) as double) as t from mins)
select enc, item, round(case when count(value) < 2 then null when min(value) = max(value) then 0 else degrees(atan(regr_slope(value, t))) end, 6) as angle from r group by 1, 2"""
)
def trend_angle(spark: SparkSession, d: str) -> DataFrame:
    return S.trend_angle(minutes(spark, d)).withColumn("angle", F.round("angle", 6))


@query(
    f"""with {MIN}, p as (select *, cast(ntile(3) over (partition by enc, item order by t, event_id) as int) as part from mins)
select enc, item, part, max(value) as max, min(value) as min, round(avg(value), 6) as mean from p group by 1, 2, 3"""
)
def series_stats_partitioned(spark: SparkSession, d: str) -> DataFrame:
    return S.partition_stats(minutes(spark, d), 3, order=("t", "event_id")).withColumn("mean", F.round("mean", 6))


@query(
    f"""with {EV}, s as (select enc, item, round(quantile_cont(value, 0.5), 6) as median, min(value) as low, max(value) as high from ev group by enc, item)
select e.enc, i.item, s.median, s.low, s.high from (select distinct enc from ev) e cross join (select distinct item from ev) i left join s on s.enc = e.enc and s.item = i.item"""
)
def series_stats_median(spark: SparkSession, d: str) -> DataFrame:
    """Level and range of each series over all events."""
    e = ev(spark, d)
    return S.signal_stats(e, e, e).withColumn("median", F.round("median", 6))


@query(f"with {MIN} select enc, item, event_id, t - min(t) over (partition by enc, item) as t from mins")
def rebased_times(spark: SparkSession, d: str) -> DataFrame:
    return S.rebase(minutes(spark, d)).select("enc", "item", "event_id", "t")


@query(
    f"""with {MIN}, m as (select max(t) / (0.75 * pi()) as base from mins)
select enc, event_id, round(sin(t / 1.0::double), 6) as pe0, round(cos(t / 1.0::double), 6) as pe1, round(sin(t / pow(base, 1.0)), 6) as pe2, round(cos(t / pow(base, 1.0)), 6) as pe3 from mins cross join m"""
)
def positional_encoding(spark: SparkSession, d: str) -> DataFrame:
    m = minutes(spark, d)
    t_max = float(m.agg(F.max("t")).head()[0] or 1)  # a fitted parameter
    return S.positional_encoding(m, t_max, 4).select("enc", "event_id", *[F.round(f"pe{k}", 6).alias(f"pe{k}") for k in range(4)])


@query(
    f"""with recursive {MIN}, r as (select item, cast(case when t <= 1 then 0 else ceil(log2(t)) end as int) as k, value from mins where t >= 0 and value is not null),
c as (select item, k, count(*) as n, row_number() over (partition by item order by k) as i from r group by item, k),
f as (select item, k, i, 0 as g, case when n >= 200 then 1 else 0 end as g2, case when n >= 200 then 0 else n end as acc from c where i = 1
  union all select c.item, c.k, c.i, f.g2, case when f.acc + c.n >= 200 then f.g2 + 1 else f.g2 end, case when f.acc + c.n >= 200 then 0 else f.acc + c.n end from f join c on c.item = f.item and c.i = f.i + 1)
select r.item, cast(f.g as int) as g, min(r.k) as k_from, max(r.k) as k_to, count(*) as n, round(quantile_cont(r.value, 0.5), 6) as median from r join f on f.item = r.item and f.k = r.k group by 1, 2"""
)
def time_buckets(spark: SparkSession, d: str) -> DataFrame:
    return S.time_buckets(minutes(spark, d), 200).withColumn("median", F.round("median", 6))


@query(f"with {MIN} select item, max(t) as t_max, case when max(t) > 2880 then 'days' when max(t) > 120 then 'hours' else 'minutes' end as unit from mins group by item")
def time_units(spark: SparkSession, d: str) -> DataFrame:
    return S.time_unit(minutes(spark, d))


@query(
    f"""with {MIN}, good as (select item from mins group by item having count(distinct enc) >= 0.5 * (select count(distinct enc) from mins)),
tv as (select enc, item, ts, coalesce(avg(value) filter (trusted), avg(value) filter (not trusted)) as value from ev where value is not null group by 1, 2, 3),
tm as (select enc, item, cast(floor((epoch_us(ts) - epoch_us(admit)) / 60000000.0) as bigint) as t, value from tv join adm using (enc)),
r as (select enc, item, value, cast(t - min(t) over (partition by enc, item) as double) as t from tm where item in (select item from good))
select enc, item, round(avg(value), 6) as mean, min(value) as low, max(value) as high, round(case when count(value) < 2 then null when min(value) = max(value) then 0 else degrees(atan(regr_slope(value, t))) end, 6) as angle from r group by 1, 2"""
)
def level_and_trend(spark: SparkSession, d: str) -> DataFrame:
    """Level and trend of each encounter and signal after resolving source conflicts."""
    resolved = E.trusted_override(E.drop_missing(ev(spark, d)))
    timed = E.minutes_since(resolved, adm(spark, d)).select("enc", "item", "t", "value")
    s = S.rebase(U.well_supported(timed, 0.5))
    slope = F.regr_slope("value", F.col("t").cast("double"))
    angle = F.when(F.count("value") < 2, F.lit(None)).when(F.min("value") == F.max("value"), F.lit(0.0)).otherwise(F.degrees(F.atan(slope)))
    return s.groupBy("enc", "item").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(angle, 6).alias("angle"))


@query(f"with {EV} select item, count(*) as n, rank() over (order by count(*) desc, item) as place from ev group by item")
def measurement_ranking(spark: SparkSession, d: str) -> DataFrame:
    c = ev(spark, d).groupBy("item").agg(F.count("*").alias("n"))
    return c.withColumn("place", F.rank().over(Window.orderBy(F.desc("n"), "item")).cast("long"))


@query(
    f"""with {EV}, c as (select item, enc, count(*) as n from ev group by 1, 2)
select item, round(quantile_cont(n, 0.25), 6) as q1, round(quantile_cont(n, 0.5), 6) as median, round(quantile_cont(n, 0.75), 6) as q3, min(n) as low, max(n) as high, round(avg(n), 6) as mean from c group by item"""
)
def measurements_per_encounter(spark: SparkSession, d: str) -> DataFrame:
    c = ev(spark, d).groupBy("item", "enc").agg(F.count("*").alias("n"))
    q = F.percentile("n", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return c.groupBy("item").agg(q.alias("q"), F.min("n").alias("low"), F.max("n").alias("high"), F.round(F.avg("n"), 6).alias("mean")).select("item", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q1", "median", "q3"))], "low", "high", "mean")


@query(f"with {EV} select enc, count(*) as n from ev group by enc")
def observations_per_encounter(spark: SparkSession, d: str) -> DataFrame:
    return ev(spark, d).groupBy("enc").agg(F.count("*").alias("n"))
