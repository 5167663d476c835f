"""Queries of the general operators for training data (problems 1, 2, 3, 5 and 6), over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators.intervals import periods_and_gaps, stay_intervals
from cohortloom.operators.regular import empty_runs, fit, regular_series
from cohortloom.operators.spikes import flag_rows
from cohortloom.operators.units import weights_in_kg
from cohortloom.operators.wide import cell_values, differing_cells, item_types, number_cells, wide_table
from cohortloom.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return periods_and_gaps(stay_intervals(table(spark, d, "icustays"), table(spark, d, "admissions")))


def p2_weights(spark: SparkSession, d: str) -> DataFrame:
    w = weights_in_kg(table(spark, d, "chartevents"), table(spark, d, "static_fields"))
    return w.select("row_id", "hadm_id", "field_unit", "unit", F.round("kg", 6).alias("kg"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    w = weights_in_kg(table(spark, d, "chartevents"), table(spark, d, "static_fields"))
    return w.filter("unit <> field_unit").select("row_id", "unit")


def _values(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, d, "chartevents")
    types = item_types(events, table(spark, d, "d_items"), table(spark, d, "static_fields"))
    return cell_values(events, types), types


def p3_cells(spark: SparkSession, d: str) -> DataFrame:
    return number_cells(*_values(spark, d)).withColumn("number", F.round("number", 6))


def p3_wide(spark: SparkSession, d: str) -> DataFrame:
    w = wide_table(*_values(spark, d))
    return w.select(*[F.round(c, 6).alias(c) if c.startswith("n_") else F.col(c) for c in w.columns if c != "differing"], F.array_join(F.col("differing").cast("array<string>"), ",").alias("differing"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return differing_cells(*_values(spark, d))


def p5_series(spark: SparkSession, d: str) -> DataFrame:
    return regular_series(fit(table(spark, d, "chartevents"), table(spark, d, "grid_items"))).withColumn("x", F.round("x", 6))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    series = regular_series(fit(table(spark, d, "chartevents"), table(spark, d, "grid_items")))
    return empty_runs(series).select("hadm_id", "itemid", "slot_from", "slot_to")


# Fixed values for the monitored items: the bounds a living patient's reading lies in (above the first, up to
# the second, in the item's unit) and the least movement that counts as one scale.
LIMITS = [
    (2101, 0.0, 300.0, 1.0),  # heart rate, bpm
    (2102, 0.0, 300.0, 1.0),  # mean arterial pressure, mmHg
    (2103, 0.0, 110.0, 0.3),  # respiratory rate, insp/min
    (2104, 0.0, 100.0, 0.15),  # oxygen saturation, %
    (2105, 20.0, 45.0, 0.05),  # core temperature, deg C
    (2106, 0.0, 2000.0, 2.0),  # blood glucose, mg/dL
]


def limits(spark: SparkSession) -> DataFrame:
    """Limits of the monitored items, a table that the caller of the operator gives."""
    return spark.createDataFrame(LIMITS, "itemid bigint, low double, high double, least double")


def p6_flags(spark: SparkSession, d: str) -> DataFrame:
    return flag_rows(table(spark, d, "chartevents"), table(spark, d, "grid_items"), limits(spark)).select("row_id", "hadm_id", "itemid", "x", "reason")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return flag_rows(table(spark, d, "chartevents"), table(spark, d, "grid_items"), limits(spark)).select("row_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p2_found, p2_weights, p3_found, p3_cells, p3_wide, p5_found, p5_series, p6_found, p6_flags)
}

_NUMBER = """coalesce(case when not isnan(valuenum) then valuenum end,
  try_cast(nullif(replace(regexp_extract(regexp_replace(value, '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200B}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]', '', 'g'), '-?[0-9]+(?:[.,][0-9]+)?'), ',', '.'), '') as double))"""

_TYPED = f"""own as (
  select itemid, count(case when not isnan(valuenum) then 1 end) as numbers,
    count(case when valuenum is null and trim(value) <> '' then 1 end) as texts
  from chartevents group by itemid),
typed as (
  select o.itemid, case when lower(d.param_type) = 'text' then true when lower(d.param_type) = 'numeric' then false
    else o.numbers < o.texts end as is_text
  from own o left join d_items d on d.itemid = o.itemid
  where o.itemid not in (select itemid from static_fields)),
readings as (
  select c.row_id, c.hadm_id, c.itemid, cast(floor(epoch(c.charttime)) as bigint) as charttime_s, t.is_text, {_NUMBER} as x, lower(trim(value)) as w
  from chartevents c join typed t on t.itemid = c.itemid where c.hadm_id is not null and c.charttime is not null)"""

_AGREED = f"""with {_TYPED},
cells as (
  select r.hadm_id, c.charttime, r.itemid, r.is_text, r.x, r.w, c.storetime from readings r join chartevents c on c.row_id = r.row_id
  where case when r.is_text then r.w <> '' else r.x is not null end)
select hadm_id, charttime, case when is_text then 't_' else 'n_' end || itemid as name, itemid, is_text,
  round(case when min(x) = max(x) then min(x) else avg(x) end, 6) as number, arg_max(w, struct_pack(s := storetime, w := w)) as word,
  case when is_text then count(distinct w) else count(distinct x) end > 1 as differs
from cells group by hadm_id, charttime, itemid, is_text"""

ORACLE: dict[str, str] = {
    "p1_found": """
with given as (
  select 'icu' as scope, hadm_id as entity_id, intime as s, outtime as e from icustays
  union all select 'hospital', subject_id, admittime, dischtime from admissions),
good as (
  select distinct scope, entity_id, cast(floor(epoch(s)) as bigint) as s, cast(floor(epoch(e)) as bigint) as e from given
  where entity_id is not null and s is not null and e > s),
reach as (
  select *, max(e) over (partition by scope, entity_id order by s, e rows between unbounded preceding and 1 preceding) as far from good),
marked as (
  select *, sum(case when far is null or s > far then 1 else 0 end) over (partition by scope, entity_id order by s, e rows unbounded preceding) as part from reach),
periods as (select scope, entity_id, min(s) as start_s, max(e) as end_s from marked group by scope, entity_id, part),
gaps as (
  select scope, entity_id, lag(end_s) over (partition by scope, entity_id order by start_s) as start_s, start_s as end_s from periods)
select scope, entity_id, 'period' as kind, start_s, end_s from periods
union all select scope, entity_id, 'gap', start_s, end_s from gaps where start_s is not null""",
    "p3_found": f"""
with {_TYPED}
select hadm_id, itemid, charttime_s from readings
where case when is_text then w <> '' else x is not null end
group by hadm_id, itemid, charttime_s
having count(distinct case when is_text then w else cast(x as varchar) end) > 1""",
    "p3_wide": f"""
select * from (select hadm_id, charttime, coalesce(string_agg(case when differs then cast(itemid as varchar) end, ',' order by itemid), '') as differing from ({_AGREED}) group by all)
left join (pivot (select hadm_id, charttime, name, number from ({_AGREED}) where not is_text) on name using first(number) group by hadm_id, charttime) using (hadm_id, charttime)
left join (pivot (select hadm_id, charttime, name, word from ({_AGREED}) where is_text) on name using first(word) group by hadm_id, charttime) using (hadm_id, charttime)""",
    "p3_cells": f"""
with {_TYPED}
select hadm_id, itemid, charttime_s, round(case when min(x) = max(x) then min(x) else avg(x) end, 6) as number, min(x) < max(x) as differs
from readings where not is_text and x is not null group by hadm_id, itemid, charttime_s""",
    "p5_found": f"""
with cells as (
  select distinct c.hadm_id, c.itemid, cast(floor(epoch(c.charttime) / (60 * g.step_min)) as bigint) as slot
  from chartevents c join grid_items g on g.itemid = c.itemid
  where {_NUMBER} is not null and c.hadm_id is not null and c.charttime is not null),
steps as (select *, lag(slot) over (partition by hadm_id, itemid order by slot) as before from cells)
select hadm_id, itemid, before + 1 as slot_from, slot - 1 as slot_to from steps where slot - before > 1""",
}
