"""Queries that explain clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.spread import settled
from cohortloom.operators import itemsets as I
from cohortloom.operators import report as R
from cohortloom.operators.static import days_between
from cohortloom.plans.registry import query
from cohortloom.plans.views import CODE, ENC, EV, STAY, code, enc, ev, stay
from cohortloom.sources.tables import table

_SUMMARY = """count(*) as size, round(quantile_cont(num, 0.25), 6) as q1, round(quantile_cont(num, 0.5), 6) as median, round(quantile_cont(num, 0.75), 6) as q3,
  round(avg(cast(died as int)), 6) as mortality, round(avg(cast(cat = 'BUILDING' as int)), 6) as share, grouping(lab) = 1 as population"""


@query(f"with {ENC}, g as (select lab, {_SUMMARY} from enc group by grouping sets ((), (lab))) select population, lab, size, round(100.0::double * size / max(case when population then size end) over (), 6) as percent, q1, median, q3, mortality, share from g")
def cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    s = R.cluster_summary(enc(spark, d), "lab", "num", "died", F.col("cat") == "BUILDING")
    return s.withColumns({c: F.round(c, 6) for c in ("percent", "q1", "median", "q3", "mortality", "share")})


@query(f"with {ENC}, m as (select lab, count(*) as n, avg(cast(died as double)) as mortality, stddev_samp(cast(died as double)) as sd from enc group by lab) select lab, n, round(mortality, 6) as mortality, round(sd / sqrt(n), 6) as se from m")
def mortality_ci(spark: SparkSession, d: str) -> DataFrame:
    return R.mortality_interval(enc(spark, d), "lab", "died").select("lab", "n", F.round("mortality", 6).alias("mortality"), F.round("se", 6).alias("se"))


@query()
def mortality_interval(spark: SparkSession, d: str) -> DataFrame:
    return R.mortality_interval(enc(spark, d), "lab", "died")


@query("with s as (select p.gender, i.first_careunit as station from icustays i join admissions a using (hadm_id) join patients p using (subject_id)), n as (select gender, station, count(*) as n from s group by 1, 2) select gender, station, n, round(100.0::double * n / sum(n) over (partition by gender), 6) as percent from n")
def station_histogram(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "admissions").select("hadm_id", "subject_id")
    s = table(spark, d, "icustays").join(a, "hadm_id").join(table(spark, d, "patients"), "subject_id").select("gender", F.col("first_careunit").alias("station"))
    return R.histogram_of(s, "gender", "station").withColumn("percent", F.round("percent", 6))


@query("with n as (select ethnicity, diagnosis, count(*) as n from admissions where diagnosis is not null group by 1, 2), r as (select *, cast(row_number() over (partition by ethnicity order by n desc, diagnosis) as int) as place from n) select * from r where place <= 5")
def top_texts(spark: SparkSession, d: str) -> DataFrame:
    return R.top_values(table(spark, d, "admissions"), "ethnicity", "diagnosis", 5)


@query(
    f"""with {CODE}, {ENC}, total as (select count(*) as n from enc), pop as (select l2 as category, count(distinct enc) / any_value(n)::double as p from code join enc using (enc), total group by 1),
size as (select lab, count(*) as n from enc group by 1), inside as (select lab, l2 as category, count(distinct enc)::double as n from code join enc using (enc) group by 1, 2),
x as (select s.lab, p.category, coalesce(i.n / s.n, 0) - p.p as difference from pop p cross join size s left join inside i on i.lab = s.lab and i.category = p.category)
select lab, category, round(difference, 6) as difference, round(max(abs(difference)) over (partition by category), 6) as largest from x"""
)
def prevalence_diff(spark: SparkSession, d: str) -> DataFrame:
    p = R.prevalence_difference(code(spark, d), enc(spark, d), "lab", "l2")
    return p.withColumns({c: F.round(c, 6) for c in ("difference", "largest")})


@query(
    f"""with {ENC}, i as (select lab, cat, count(*)::double as n from enc group by 1, 2), f as (select lab, cat, n / sum(n) over (partition by lab) as f from i),
m as (select cat, count(*)::double as m from enc group by 1), p as (select cat, m / sum(m) over () as p, count(*) over () as k from m)
select lab, cat, round(case when k < 3 then f else f - p end, 6) as frequency from f join p using (cat)"""
)
def category_freq_by_cluster(spark: SparkSession, d: str) -> DataFrame:
    return R.category_frequency(enc(spark, d), "lab", "cat").withColumn("frequency", F.round("frequency", 6))


@query(f"with {CODE}, {ENC}, n as (select lab, l2 as category, count(*) as n from code join enc using (enc) group by 1, 2) select lab, category, n, round(n / sum(n) over (partition by lab), 6) as share from n")
def code_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return R.occurrence_counts(code(spark, d), enc(spark, d), "lab", "l2").withColumn("share", F.round("share", 6))


_L2 = "codes as (select distinct enc, l2 as code from code)"


@query(
    f"""with {CODE}, {ENC}, {_L2}, c as (select code, lab, count(*)::double as n, sum(cast(died as int))::double as dead from codes join enc using (enc) group by 1, 2),
p as (select *, sum(dead) over (partition by code) / sum(n) over (partition by code) as pop from c)
select code, cast(sum(n) as bigint) as total, round(max(pop), 6) as mortality, round(sum((dead / n - pop) * (dead / n - pop)), 6) as surprise from p group by code"""
)
def code_mortality_table(spark: SparkSession, d: str) -> DataFrame:
    c = code(spark, d).select("enc", F.col("l2").alias("code"))
    return R.code_mortality(c, enc(spark, d), "lab", "died").withColumns({x: F.round(x, 6) for x in ("mortality", "surprise")})


_JS = "case when {p} > 0 then {p} * log2({p} / (({p} + {q}) / 2)) else 0 end + case when {q} > 0 then {q} * log2({q} / (({p} + {q}) / 2)) else 0 end"


@query(
    f"""with {CODE}, {ENC}, {_L2}, s as (select lab, count(*)::double as size from enc group by 1), q as (select lab, size / sum(size) over () as q from s),
n as (select code, lab, count(*)::double as n from codes join enc using (enc) group by 1, 2),
f as (select c.code, q.lab, q.q, coalesce(n.n, 0) as n from (select distinct code from n) c cross join q left join n on n.code = c.code and n.lab = q.lab),
p as (select *, n / sum(n) over (partition by code) as p from f)
select code, cast(sum(n) as bigint) as total, round(sqrt(greatest(sum({_JS.format(p='p', q='q')}) / 2, 0)), 6) as distance from p group by code"""
)
def code_distribution_js(spark: SparkSession, d: str) -> DataFrame:
    c = code(spark, d).select("enc", F.col("l2").alias("code"))
    return R.code_distribution(c, enc(spark, d), "lab").withColumn("distance", F.round("distance", 6))


@query(
    f"""with {CODE}, {ENC}, size as (select lab, count(*)::double as n from enc group by 1), i as (select lab, l1 as category, count(distinct enc)::double as n from code join enc using (enc) group by 1, 2),
f as (select s.lab, c.category, exp(coalesce(i.n / s.n, 0)) as e from size s cross join (select distinct category from i) c left join i on i.lab = s.lab and i.category = c.category),
p as (select lab, category, e / sum(e) over (partition by lab) as p from f)
select a.lab as "left", b.lab as "right", round(sqrt(greatest(sum({_JS.format(p='a.p', q='b.p')}) / 2, 0)), 6) as distance from p a join p b using (category) group by 1, 2"""
)
def cluster_js_matrix(spark: SparkSession, d: str) -> DataFrame:
    return R.cluster_distances(code(spark, d), enc(spark, d), "lab", "l1").withColumn("distance", F.round("distance", 6))


@query(
    f"""with {CODE}, {ENC}, pl as (select lab, enc, l2 as code from code join enc using (enc)), n as (select lab, code, count(*) as n from pl group by 1, 2),
best as (select lab, code, cast(row_number() over (partition by lab order by n desc, code) as int) as place from n qualify place <= 20),
f as (select pl.lab, pl.enc, min(place) as place from pl join best using (lab, code) group by 1, 2), nw as (select lab, place, count(*) as fresh from f group by 1, 2), s as (select lab, count(*) as size from enc group by 1),
c as (select b.lab, b.place, b.code, s.size, sum(coalesce(fresh, 0)) over (partition by b.lab order by b.place) as covered from best b left join nw using (lab, place) join s on s.lab = b.lab)
select lab, place, code, round(100.0::double * covered / size, 6) as percent from (select *, coalesce(lag(covered) over (partition by lab order by place), 0) as before from c) where before < size"""
)
def cumulative_cover(spark: SparkSession, d: str) -> DataFrame:
    c = code(spark, d).select("enc", F.col("l2").alias("code"))
    return R.cumulative_cover(c, enc(spark, d), "lab").withColumn("percent", F.round("percent", 6))


@query(
    f"""with {ENC}, b as (select quantile_cont(price, 0.95) as b from enc), t as (select price, not died as alive from enc, b where price <= b), r as (select min(price) as lo, max(price) as hi from t)
select cast(least(floor((price - lo) / ((hi - lo) / 8)), 7) as int) as bin, count(*) as n, round(avg(cast(alive as int)), 6) as survival from t, r group by 1"""
)
def survival_bins(spark: SparkSession, d: str) -> DataFrame:
    return R.survival_bins(enc(spark, d).withColumn("alive", ~F.col("died")), "price", "alive", 8, 95).withColumn("survival", F.round("survival", 6))


@query(
    f"""with {ENC}, {STAY}, x as (select lab, died, (epoch_us(e) - epoch_us(s)) / 86400000000.0::double as t from enc join stay using (enc)),
n as (select lab, t, count(*) as n, sum(cast(died as int)) as deaths from x group by 1, 2), r as (select *, sum(n) over (partition by lab order by t desc) as at_risk from n),
q as (select *, 1 - deaths / at_risk::double as q from r)
select lab, t, cast(at_risk as bigint) as at_risk, cast(deaths as bigint) as deaths, round(case when min(q) over w <= 0 then 0 else exp(sum(case when q > 0 then ln(q) else 0 end) over w) end, 6) as survival from q window w as (partition by lab order by t)"""
)
def kaplan_meier(spark: SparkSession, d: str) -> DataFrame:
    x = enc(spark, d).join(stay(spark, d), "enc").withColumn("t", days_between("s", "e"))
    return R.kaplan_meier(x, "lab", "t", "died").withColumn("survival", F.round("survival", 6))


@query(
    f"""with {EV}, b as (select quantile_cont(value, 0.05) as lo, quantile_cont(value, 0.95) as hi, quantile_cont(value, 0.9) as up, 3 * quantile_cont(value, 0.5) as cap from ev)
select count(*) filter (value <= up) as n_upper, count(*) filter (value >= lo and value <= hi) as n_both, round(sum(least(value, cap)), 4) as clipped, count(*) filter (value <= ceil(least(hi, 75.0::double))) as n_capped from ev, b"""
)
def outlier_trim(spark: SparkSession, d: str) -> DataFrame:
    e = ev(spark, d)
    parts = [
        R.trimmed(e, "value", 90).agg(F.count("*").alias("n_upper")),
        R.trimmed(e, "value", 10, two_sided=True).agg(F.count("*").alias("n_both")),
        R.clipped(e, "value").agg(F.round(F.sum("value"), 4).alias("clipped")),
        R.capped_bmi(e, "value").agg(F.count("value").alias("n_capped")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


@query(
    """with r as (select min(l_quantity) as lo, max(l_quantity) as hi from lineitem), c as (select floor((l_quantity - lo) * 4 / (hi - lo)) as q, cast(l_linenumber as double) as l, l_discount from lineitem, r)
select q as l_quantity_cell, case when (select count(distinct l_linenumber) from lineitem) <= 6 then l else floor((l - 1) * 4 / ((select max(l_linenumber) from lineitem) - 1)) end as l_linenumber_cell, round(avg(l_discount), 6) as mean, count(*) as n from c
where q < 4 and case when (select count(distinct l_linenumber) from lineitem) <= 6 then true else floor((l - 1) * 4 / ((select max(l_linenumber) from lineitem) - 1)) < 4 end group by 1, 2"""
)
def heatmap_grid(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_quantity", F.col("l_linenumber").cast("double").alias("l_linenumber"), "l_discount")
    return R.heat_map(li, "l_quantity", "l_linenumber", "l_discount").withColumn("mean", F.round("mean", 6))


@query("select l_returnflag as arg_value, round(avg(l_extendedprice), 4) as objective, count(*) as n from lineitem group by 1")
def arg_means(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("arg_value")).agg(F.round(F.avg("l_extendedprice"), 4).alias("objective"), F.count("*").alias("n"))


@query(
    """with m as (select first_careunit as c from icustays where first_careunit is not null group by 1 order by count(*) desc, 1 limit 1)
select coalesce(first_careunit, c) as first_careunit, count(*) as n from icustays, m group by 1"""
)
def arg_mode_impute(spark: SparkSession, d: str) -> DataFrame:
    return R.mode_impute(table(spark, d, "icustays").select("first_careunit"), ["first_careunit"]).groupBy("first_careunit").agg(F.count("*").alias("n"))


@query(
    f"""with {ENC}, a as (select enc as run, 'cat' as arg, cat as value from enc union all select enc, 'one', '1' from enc union all select enc, 'lab', cast(lab as varchar) from enc)
select arg, value, count(*) as n from a where arg in (select arg from a group by arg having count(distinct value) > 1) group by 1, 2"""
)
def drop_constant_args(spark: SparkSession, d: str) -> DataFrame:
    e = enc(spark, d)
    a = e.select(F.col("enc").alias("run"), F.explode(F.map_from_arrays(F.array(F.lit("cat"), F.lit("one"), F.lit("lab")), F.array("cat", F.lit("1"), F.col("lab").cast("string")))).alias("arg", "value"))
    return R.varying_args(a).groupBy("arg", "value").agg(F.count("*").alias("n"))


@query(
    f"""with {ENC}, v as (select 'num' as attr, lab, num as value from enc union all select 'price', lab, price from enc)
select attr, lab, count(*) as n, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) as iqr from v where value is not null group by 1, 2 having count(*) >= 2"""
)
def cluster_attribute_spread(spark: SparkSession, d: str) -> DataFrame:
    e = enc(spark, d)
    v = e.select(F.lit("num").alias("attr"), "lab", F.col("num").alias("value")).union(e.select(F.lit("price"), "lab", "price"))
    return R.spread_by_cluster(v, "lab").withColumns({c: F.round(c, 6) for c in ("median", "iqr")})


@query(f"with {ENC} select lab, round(quantile_cont(num, 0.5), 6) as median, round(quantile_cont(num, 0.5) - quantile_cont(num, 0.25), 6) as below, round(quantile_cont(num, 0.75) - quantile_cont(num, 0.5), 6) as above from enc group by lab")
def medians_and_errors(spark: SparkSession, d: str) -> DataFrame:
    return R.medians_and_errors(enc(spark, d), "lab", "num").withColumns({c: F.round(c, 6) for c in ("median", "below", "above")})


@query()
def age_survival_fit(spark: SparkSession, d: str) -> DataFrame:
    """Cubic fit of survival over age, evaluated at ten points."""
    from cohortloom.operators.static import age_years

    a = table(spark, d, "admissions").join(table(spark, d, "patients"), "subject_id").select(age_years("dob", "admittime").alias("age"), F.when(F.col("dod").isNull(), 1.0).otherwise(0.0).alias("alive"))
    coef, lo, hi = R.polynomial(a, "age", "alive", 3)
    rows = [(lo + (hi - lo) * i / 9, sum(c * (2 * i / 9 - 1) ** k for k, c in enumerate(coef))) for i in range(10)]
    return spark.createDataFrame(rows, "age double, survival double")


@query(
    f"""with {CODE}, {ENC}, p as (select lab, l1, count(distinct enc)::double as n from code join enc using (enc) group by 1, 2), s as (select lab, count(*) as size from enc group by 1),
t as (select lab, l1, n / size - 0.4::double as x from p join s using (lab))
select lab, l1, printf('%+.1f%%', 100 * x) as text, case when x >= 0.1 then '++' when x >= 0.02 then '+' when x <= -0.1 then '--' when x <= -0.02 then '-' else '~' end as direction from t"""
)
def enrichment_texts(spark: SparkSession, d: str) -> DataFrame:
    p = R.prevalence(code(spark, d), enc(spark, d), "lab", "l1").withColumn("x", F.col("prevalence") - 0.4)
    return p.select("lab", F.col("category").alias("l1"), R.enrichment_text("x").alias("text"), R.direction("x").alias("direction"))


def _tx(spark: SparkSession, d: str) -> DataFrame:
    tx = I.transactions(code(spark, d).select("enc", F.col("l1").alias("item")))
    return tx.join(enc(spark, d).select("enc", "lab"), "enc")


_SETS = f"""{CODE}, items as (select distinct enc, l1 as item from code), total as (select count(distinct enc) as n from items),
s1 as (select [item] as itemset, count(*) as n from items group by 1),
s2 as (select [a.item, b.item] as itemset, count(*) as n from items a join items b on a.enc = b.enc and a.item < b.item group by 1),
s3 as (select [a.item, b.item, c.item] as itemset, count(*) as n from items a join items b on a.enc = b.enc and a.item < b.item join items c on c.enc = a.enc and b.item < c.item group by 1),
s4 as (select [a.item, b.item, c.item, x.item] as itemset, count(*) as n from items a join items b on a.enc = b.enc and a.item < b.item join items c on c.enc = a.enc and b.item < c.item join items x on x.enc = a.enc and c.item < x.item group by 1),
s5 as (select [a.item, b.item, c.item, x.item, y.item] as itemset, count(*) as n from items a join items b on a.enc = b.enc and a.item < b.item join items c on c.enc = a.enc and b.item < c.item join items x on x.enc = a.enc and c.item < x.item join items y on y.enc = a.enc and x.item < y.item group by 1),
allsets as (select * from s1 union all select * from s2 union all select * from s3 union all select * from s4 union all select * from s5),
freq as (select itemset, allsets.n from allsets, total where allsets.n >= 0.05::double * total.n)"""


@query(f"with {_SETS} select array_to_string(itemset, '|') as itemset, n from freq f where not exists (select 1 from freq g where len(g.itemset) > len(f.itemset) and list_has_all(g.itemset, f.itemset))")
def frequent_itemsets_max(spark: SparkSession, d: str) -> DataFrame:
    return I.maximal(I.frequent(_tx(spark, d), 0.05)).select(F.array_join("itemset", "|").alias("itemset"), "n")


@query(
    f"""with {_SETS}, {ENC}, labelled as (select i.enc, e.lab, list(i.item) as items from items i join enc e using (enc) group by 1, 2)
select l.lab, array_to_string(f.itemset, '|') as itemset, count(*) as n from labelled l join freq f on list_has_all(l.items, f.itemset) group by 1, 2"""
)
def itemset_support(spark: SparkSession, d: str) -> DataFrame:
    """Support counts of all frequent sets, of any size."""
    tx = _tx(spark, d)
    return I.support_counts(tx, I.frequent(tx, 0.05), ["lab"]).select("lab", F.array_join("itemset", "|").alias("itemset"), "n")


def _enriched(spark: SparkSession, d: str) -> DataFrame:
    tx = _tx(spark, d)
    return I.enrichment(tx, I.frequent(tx, 0.05), "lab")


@query(
    f"""with {_SETS}, {ENC}, labelled as (select i.enc, e.lab, list(i.item) as items from items i join enc e using (enc) group by 1, 2),
size as (select lab, count(*) as size from labelled group by 1), t as (select count(*) as n_all from labelled),
hit as (select l.lab, f.itemset, count(*) as a from labelled l join freq f on list_has_all(l.items, f.itemset) group by 1, 2),
tot as (select itemset, sum(a) as n_set from hit group by 1)
select s.lab, array_to_string(tot.itemset, '|') as itemset, cast(coalesce(a, 0) as bigint) as a, cast(size - coalesce(a, 0) as bigint) as b, cast(n_set - coalesce(a, 0) as bigint) as c, cast(n_all - size - n_set + coalesce(a, 0) as bigint) as d
from tot cross join size s cross join t left join hit on hit.lab = s.lab and hit.itemset = tot.itemset"""
)
def contingency_2x2(spark: SparkSession, d: str) -> DataFrame:
    return _enriched(spark, d).select("lab", F.array_join("itemset", "|").alias("itemset"), "a", "b", "c", "d")


@query(f"with {_SETS} select count(*) as n_sets, 0.01::double / (count(*) * 5) as threshold from freq")
def bonferroni_threshold(spark: SparkSession, d: str) -> DataFrame:
    sets = I.frequent(_tx(spark, d), 0.05)
    return sets.agg(F.count("*").alias("n_sets"), (F.lit(0.01) / (F.count("*") * 5)).alias("threshold"))


@query(
    f"""with {CODE}, {ENC}, {_L2}, c as (select code, lab, count(*) as n, avg(cast(died as int)) as mortality from codes join enc using (enc) group by 1, 2)
select code, lab, n, round(mortality, 6) as mortality, round(100.0::double * n / sum(n) over (partition by code), 6) as share from c"""
)
def code_mortality_by_cluster(spark: SparkSession, d: str) -> DataFrame:
    c = code(spark, d).select("enc", F.col("l2").alias("code"))
    return R.code_mortality_cells(c, enc(spark, d), "lab", "died").withColumns({x: F.round(x, 6) for x in ("mortality", "share")})


_NUMBERS = ["age", "bmi", "days", "days_survivors", "days_deceased", "days_hospital", "visits"]
_FLAGS = ["died_28", "died_hospital", "died_later", "female"]


def hospital_records(spark: SparkSession, d: str) -> DataFrame:
    """Static records of the admissions, labelled by their first station in alphabetical order."""
    from cohortloom.operators import static as S

    stays = table(spark, d, "icustays")
    a = table(spark, d, "admissions").select("hadm_id", "subject_id", "admittime", "dischtime").join(table(spark, d, "patients"), "subject_id", "left")
    size = S.median_of_medians(table(spark, d, "chartevents"), table(spark, d, "static_fields"))
    station = stays.groupBy("hadm_id").agg(F.min("first_careunit").alias("station"))
    r = a.join(S.stays_summary(stays), "hadm_id", "left").join(size, "hadm_id", "left").join(station, "hadm_id", "left")
    f = S.survival_flags("dod", "admittime", "dischtime")
    r = r.select(
        "hadm_id",
        "station",
        S.age_years("dob", "admittime").alias("age"),
        S.bmi("weight_kg", "height_cm").alias("bmi"),
        F.col("FUTURE_days_in_care").alias("days"),
        S.days_between("admittime", "dischtime").alias("days_hospital"),
        F.col("FUTURE_icu_visits").cast("double").alias("visits"),
        (~f["FUTURE_survival"]).alias("died_28"),
        (~f["FUTURE_survival_to_discharge"]).alias("died_hospital"),
        (~f["FUTURE_survival_all_time"]).alias("died_later"),
        (F.upper("gender") == "F").alias("female"),
    )
    return S.split_by_survival(r.withColumn("alive", ~F.col("died_28")), "days", "alive").drop("alive")


_HOSPITAL = """moments as (select hadm_id, field_name, itemid, charttime, avg(valuenum) as v from chartevents join static_fields using (itemid) where valuenum is not null and valuenum <> 0 group by all),
per_item as (select hadm_id, field_name, itemid, quantile_cont(v, 0.5) as v from moments group by all),
per_field as (select hadm_id, field_name, quantile_cont(v, 0.5) as v from per_item group by all),
size as (select hadm_id, quantile_cont(case field_name when 'weight_kg' then v when 'weight_oz' then v / 35.274::double when 'weight_lb' then v / 2.2046::double end, 0.5) as kg,
  quantile_cont(case field_name when 'height_cm' then v when 'height_in' then v * 2.54::double end, 0.5) / 100 as m from per_field group by hadm_id),
stays as (select hadm_id, min(first_careunit) as station, count(case when intime is not null and outtime is not null then 1 end)::double as visits,
  coalesce(sum(case when intime is not null and outtime is not null then (epoch_us(outtime) - epoch_us(intime)) / 1000000.0::double / 86400 end), 0) as days from icustays group by 1),
base as (select a.hadm_id, s.station, least((epoch_us(admittime) - epoch_us(dob)) / 1000000.0::double / 86400 / 365.25::double, 89.0::double) as age, z.kg / (z.m * z.m) as bmi, s.days,
  (epoch_us(dischtime) - epoch_us(admittime)) / 1000000.0::double / 86400 as days_hospital, s.visits, not coalesce(not (dod <= admittime + interval 28 days), true) as died_28,
  not coalesce(not (dod <= dischtime), true) as died_hospital, not coalesce(not (dod > admittime + interval 28 days), true) as died_later, upper(gender) = 'F' as female
  from admissions a left join patients p using (subject_id) left join stays s on s.hadm_id = a.hadm_id left join size z on z.hadm_id = a.hadm_id),
r as (select *, case when not died_28 then days end as days_survivors, case when died_28 then days end as days_deceased from base)"""


@query(
    f"""with {_HOSPITAL} select grouping(station) = 1 as population, station, count(*) as size,
  {', '.join(f"round(avg({c}), 6) as {c}_mean, round(quantile_cont({c}, 0.25), 6) as {c}_q1, round(quantile_cont({c}, 0.5), 6) as {c}_median, round(quantile_cont({c}, 0.75), 6) as {c}_q3" for c in _NUMBERS)},
  {', '.join(f"round(avg(cast({f} as int)), 6) as {f}_share" for f in _FLAGS)} from r group by grouping sets ((), (station))"""
)
def hospital_summary(spark: SparkSession, d: str) -> DataFrame:
    s = R.full_summary(hospital_records(spark, d), "station", _NUMBERS, _FLAGS)
    return s.withColumns({c: F.round(c, 6) for c in s.columns if c not in ("population", "station", "size")})


def _listed(rows: str, value: str, k: int) -> str:
    """The texts of R.listed in SQL."""
    return f"""(select population, station, string_agg(format('{{}} ({{}})', v, n), '; ' order by place) as text from
  (select *, row_number() over (partition by population, station order by n desc, v) as place from
    (select grouping(station) = 1 as population, station, {value} as v, count(*) as n from {rows} where {value} is not null group by grouping sets ((v), (station, v)))) where place <= {k} group by 1, 2)"""


@query(
    f"""with {_HOSPITAL}, texts as (select r.station, a.diagnosis from r join admissions a using (hadm_id)), units as (select r.station, i.first_careunit as unit from r join icustays i using (hadm_id)),
s as (select grouping(station) = 1 as population, station, count(*) as size, round(100.0::double * count(*) / max(count(*)) over (), 6) as percent, round(avg(cast(died_28 as int)), 6) as died_28,
  round(stddev_samp(cast(died_28 as int)) / sqrt(count(died_28)), 6) as died_28_se from r group by grouping sets ((), (station)))
select s.*, d.text as diagnoses, u.text as units from s left join {_listed('texts', 'diagnosis', 5)} d on d.population = s.population and d.station is not distinct from s.station
left join {_listed('units', 'unit', 20)} u on u.population = s.population and u.station is not distinct from s.station"""
)
def hospital_report(spark: SparkSession, d: str) -> DataFrame:
    """Size, mortality with its error, most frequent diagnoses and stations of the population and each cluster."""
    from pyspark.sql.window import Window

    r = hospital_records(spark, d)
    died = F.col("died_28").cast("int")
    s = r.groupingSets([[], [F.col("station")]], F.col("station")).agg(F.count("*").alias("size"), F.round(F.avg(died), 6).alias("died_28"), F.round(F.stddev_samp(died) / F.sqrt(F.count(died)), 6).alias("died_28_se"), F.grouping("station").alias("g"))
    s = s.withColumn("percent", F.round(100.0 * F.col("size") / F.max("size").over(Window.partitionBy()), 6)).withColumn("population", F.col("g") == 1).drop("g")  # a row for each cluster
    label = r.select("hadm_id", "station")
    texts = label.join(table(spark, d, "admissions").select("hadm_id", "diagnosis"), "hadm_id")
    units = label.join(table(spark, d, "icustays").select("hadm_id", F.col("first_careunit").alias("unit")), "hadm_id")
    return R.with_lists(s, "station", {"diagnoses": R.listed(texts, "station", "diagnosis", 5), "units": R.listed(units, "station", "unit", 20)})


@query(
    """with icu as (select hadm_id, min(first_careunit) as station from icustays group by 1), g as (select itemid from grid_items),
med as (select c.hadm_id, c.itemid, quantile_cont(c.valuenum, 0.5) as v from chartevents c join g using (itemid) where valuenum is not null group by 1, 2),
x as (select m.itemid, i.station, m.v from med m join icu i using (hadm_id) where i.station is not null),
r as (select *, rank() over (partition by itemid order by v) + (count(*) over (partition by itemid, v) - 1) / 2.0::double as r from x),
w as (select itemid, station, sum(r)::double as w, count(*) as n_in from r group by 1, 2), t as (select itemid, count(*) as n_all from x group by 1)
select itemid, station, n_in, n_all - n_in as n_out, round(case when n_all > n_in then (w - n_in * (n_all + 1) / 2.0::double) / sqrt(n_in * (n_all - n_in) * (n_all + 1) / 12.0::double) end, 6) as z from w join t using (itemid)"""
)
def rank_sum_by_signal(spark: SparkSession, d: str) -> DataFrame:
    """Median level of each monitored item, each station against the rest."""
    from cohortloom.operators.stats import rank_sum

    items = table(spark, d, "grid_items").select("itemid")
    med = table(spark, d, "chartevents").filter("valuenum is not null").join(items, "itemid", "left_semi").groupBy("hadm_id", "itemid").agg(F.percentile("valuenum", F.lit(0.5)).alias("v"))
    station = table(spark, d, "icustays").groupBy("hadm_id").agg(F.min("first_careunit").alias("station"))
    return rank_sum(med.join(station, "hadm_id"), "station", "v", ["itemid"]).withColumn("z", F.round("z", 6))


@query(f"with {EV}, s as (select c_custkey as enc, c_mktsegment as cat, c_acctbal as num from customer) select event_id, item, value, cat, num from ev join s using (enc)")
def chart_with_static(spark: SparkSession, d: str) -> DataFrame:
    """Static attributes beside each chart row."""
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("enc"), F.col("c_mktsegment").alias("cat"), F.col("c_acctbal").alias("num"))
    return ev(spark, d).join(s, "enc").select("event_id", "item", "value", "cat", "num")


def code_levels(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, DataFrame, list]]:
    """Kinds of codes: name, codes (enc, code), labels (enc, lab), and the column of each depth. Parts have the
    levels of their tree, diagnoses and procedures those that a code itself shows: its category, the category
    with one more digit, and the code."""
    stays = table(spark, d, "icustays").groupBy(F.col("hadm_id").alias("enc")).agg(F.min("first_careunit").alias("lab")).na.drop()
    out = [("part", code(spark, d), enc(spark, d).select("enc", F.col("lab").cast("string").alias("lab")), [F.col(c) for c in ("l1", "l2", "code")])]
    for kind, name, short in (("diagnosis", "diagnoses_icd", 3), ("procedure", "procedures_icd", 2)):
        c = table(spark, d, name).select(F.col("hadm_id").alias("enc"), F.replace("icd9_code", F.lit("."), F.lit("")).alias("code"))
        head = F.when(F.col("code").startswith("E"), 4).otherwise(short) if kind == "diagnosis" else F.lit(short)
        out.append((kind, c, stays, [F.substring("code", F.lit(1), head), F.substring("code", F.lit(1), head + 1), F.col("code")]))
    return out


@query()
def itemset_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Enriched maximal sets of each cluster at every depth of each kind of code, kind and depth as columns."""
    out = None
    for kind, c, labels, levels in code_levels(spark, d):
        names = [f"items{depth}" for depth in range(1, len(levels) + 1)]
        rows = c.select("enc", *[level.alias(n) for n, level in zip(names, levels)]).repartition("enc")  # before the lists are made, as lists are longer
        every = settled(rows.groupBy("enc").agg(*[F.collect_set(n).alias(n) for n in names]).join(labels, "enc").select("lab", *names))  # read several times
        for depth, name in enumerate(names, 1):
            tx = every.select("lab", F.col(name).alias("items")).filter(F.size("items") > 0)
            size = spark.createDataFrame(tx.groupBy("lab").agg(F.count("*").alias("size")).collect(), "lab string, size bigint")  # few clusters
            total = size.agg(F.sum("size").alias("n_all"))
            inside = settled(I.maximal_inside(tx, total.head().n_all or 0, 0.02, "lab"))
            e = I.tested(size, total, inside, "lab").select(F.lit(kind).alias("kind"), F.lit(depth).alias("depth"), "lab", I.itemset_text().alias("itemset"), "support", "complement_support", "factor", "p_value", "significant")
            e = settled(e)
            out = e if out is None else out.unionByName(e)
    return out
