"""Queries over scalar rules, listings, item sets with their tests, and comparisons of clusterings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.spread import settled
from cohortloom.operators import clustering as K
from cohortloom.operators import events as E
from cohortloom.operators import features as P
from cohortloom.operators import fusion as M
from cohortloom.operators import itemsets as I
from cohortloom.operators import recon as R
from cohortloom.operators import search as H
from cohortloom.operators import similarity as A
from cohortloom.operators import static as S
from cohortloom.operators import stats as X
from cohortloom.operators import taxonomy as T
from cohortloom.operators.cohort import split
from cohortloom.plans.agreement_plans import _LONG, _long
from cohortloom.plans.model_plans import vectors
from cohortloom.plans.registry import query
from cohortloom.plans.report_plans import _SETS, _enriched, _tx
from cohortloom.plans.views import CODE, ENC, EV, code, enc, ev, minutes
from cohortloom.sources.tables import table


@query("select hadm_id, gender, case when gender is null then null else upper(gender) = 'F' end as female from admissions left join patients using (subject_id)")
def model_inputs(spark: SparkSession, d: str) -> DataFrame:
    """A static table without outcomes and lists, which a model must not see."""
    a = table(spark, d, "admissions").select("hadm_id", "subject_id", "dischtime").join(table(spark, d, "patients"), "subject_id", "left")
    wide = a.select("hadm_id", "gender", (F.upper("gender") == "F").alias("female"), F.array("gender").alias("stations"), F.col("dod").isNull().alias("FUTURE_survival"), F.col("dischtime").alias("FUTURE_discharge"))
    return S.model_inputs(wide)


@query("select vec_id as id, case when label - 1 = -1 then 'Noise' else 'Cluster ' || cast(label - 1 as int) end as name from embeddings")
def cluster_names(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).withColumn("c", (F.col("label") - 1).cast("int")).select("id", S.cluster_name("c").alias("name"))


@query("select row_id, case when value is null then null else lower(case when row_id % 2 = 0 then 'TRUE' else value end) = 'true' end as flag from chartevents")
def texts_as_flags(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chartevents").select("row_id", F.when(F.col("value").isNull(), None).when(F.col("row_id") % 2 == 0, "TRUE").otherwise(F.col("value")).alias("v"))
    return c.select("row_id", H.to_bool("v").alias("flag"))


@query(
    """with x as (select itemid as item, case when param_type = 'Text' then category end as fused, case when unitname is null and category <> 'Labs' then category end as meta, label from d_items),
r as (select item, coalesce(fused, 'meta_' || meta, label) as resolved from x) select item, resolved, concat_ws('_', resolved, cast(item as varchar)) as key from r"""
)
def resolved_labels(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "d_items").select(F.col("itemid").alias("item"), F.when(F.col("param_type") == "Text", F.col("category")).alias("fused_label"), F.when(F.col("unitname").isNull() & (F.col("category") != "Labs"), F.col("category")).alias("meta"), "label")
    return E.resolved_label(x).select("item", "resolved", "key")


@query(f"with {EV}, n as (select item, count(distinct enc) as n from ev group by item) select item, n, cast(ceil(pow(n, ln(100) / ln(50000)) - 1e-9) as bigint) as drawn from n")
def plotted_sample_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Points that are drawn of each signal's encounters."""
    n = ev(spark, d).groupBy("item").agg(F.countDistinct("enc").alias("n"))
    return n.withColumn("drawn", H.plotted_sample("n"))


@query("with r as (select user_id as enc, event_type as item, min(extract('doy' from ts)) as lo, max(extract('doy' from ts)) as hi from events group by 1, 2) select a.enc, greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1)::bigint as shared from r a join r b on a.enc = b.enc where a.item = 'click' and b.item = 'view'")
def range_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Days that the ranges of two signals of an encounter share."""
    r = ev(spark, d).groupBy("enc", "item").agg(F.min(F.dayofyear("ts")).alias("lo"), F.max(F.dayofyear("ts")).alias("hi"))
    a = r.filter("item = 'click'").select("enc", F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
    b = r.filter("item = 'view'").select("enc", F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    return a.join(b, "enc").select("enc", E.overlap("lo_a", "hi_a", "lo_b", "hi_b").cast("long").alias("shared"))


@query("select o_custkey as run, o_orderkey as epoch, o_totalprice as objective, min(o_totalprice) over w as best, coalesce(o_totalprice < min(o_totalprice) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), true) as is_best from orders window w as (partition by o_custkey order by o_orderkey rows unbounded preceding)")
def running_best(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("epoch"), F.col("o_totalprice").alias("objective"))
    return H.running_best(o)


@query("select o_orderkey, cast((row_number() over (order by o_orderkey) - 1) // 100 as bigint) as page from orders")
def result_pages(spark: SparkSession, d: str) -> DataFrame:
    """Orders in pages of 100."""
    return H.pages(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100)


@query(
    """with n as (select count(*) as n from (select distinct label from embeddings)), p as (select unnest(range(1, 5)) as i),
x as (select cast(round(pow(10, log10(n - 1) * i / 5.0::double)) as bigint) as pos from n, p union select 0 union select n - 1 from n) select distinct pos from x"""
)
def spread_positions(spark: SparkSession, d: str) -> DataFrame:
    """Log-spaced places among the labels."""
    n = vectors(spark, d).select("label").distinct().count()
    return spark.createDataFrame([(p,) for p in K.spread_positions(n)], "pos bigint")


@query(
    """with x as (select o_orderkey as run, unnest(['prep_share', 'model_layers', 'model_prep_rate', 'seed']) as arg, unnest([o_orderstatus, o_orderstatus, o_orderpriority, cast(o_custkey as varchar)]) as value from orders)
select run, value, case when arg like 'prep@_%' escape '@' then 'prep' when arg like 'model@_%' escape '@' then 'model' else 'general' end as "group", regexp_replace(arg, '^(prep|model)_', '') as name from x"""
)
def routed_options(spark: SparkSession, d: str) -> DataFrame:
    """Options of runs by the part that their prefix names."""
    pairs = [("prep_share", "o_orderstatus"), ("model_layers", "o_orderstatus"), ("model_prep_rate", "o_orderpriority"), ("seed", "o_custkey")]
    x = F.explode(F.array(*[F.struct(F.lit(a).alias("arg"), F.col(c).cast("string").alias("value")) for a, c in pairs]))
    return H.routed(table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), x.alias("x")).select("run", "x.*"), ["prep", "model"])


@query("select o_orderkey as run, o_totalprice as price, case when o_orderstatus = 'F' then 1.0::double else 0.0 end as \"status=F\", case when o_orderstatus = 'O' then 1.0::double else 0.0 end as \"status=O\" from orders")
def one_hot_args(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    return H.one_hot_args(o, ["status"], {"status": ["F", "O"]})


@query(
    f"""with {_LONG}, n as (select clustering_id, label, count(*) as n from long group by 1, 2), p as (select *, n / sum(n) over (partition by clustering_id) as p from n),
q as (select clustering_id, round(exp(-sum(p * ln(p))), 6) as k_effective from p group by 1)
select 'kmeans' as algorithm, case clustering_id when 'a' then 10 when 'b' then 7 else 3 end as option, 'rand' as metric, 0.1::double as threshold, 0.2::double as actual, k_effective from q"""
)
def robustness_by_option(spark: SparkSession, d: str) -> DataFrame:
    """Robustness by algorithm and option, with the effective number of clusters."""
    named = _long(spark, d).withColumn("clustering_id", F.concat(F.lit("kmeans_"), "k"))
    q = A.label_quality(named).withColumn("k_effective", F.round("k_effective", 6))
    scores = q.select("clustering_id", F.lit("rand").alias("metric"), F.lit(0.1).alias("threshold"), F.lit(0.2).alias("actual"))
    return A.robustness_by_option(scores, q)


@query(
    """with x as (select category as label, list(distinct itemid order by itemid) as items from d_items where category is not null group by 1),
r as (select label, unnest(items) as item, unnest(range(len(items))) as i, items from x where len(items) >= 2)
select item, label, cast(case when label = 'Labs' then 0 else i end as int) as pos, cast(case when label = 'Labs' then i else 0 end as int) as grp,
  case when label = 'Labs' then label || '_' || item || '_' || i else label || '_' || array_to_string(items, '_') end as name,
  case when label = 'Labs' then label || ' (' || (i + 1) || '/' || len(items) || ')' else label end as pretty from r"""
)
def merge_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules for categories that several items share: one keeps its items apart, the others merge theirs."""
    c = M.collisions(table(spark, d, "d_items").filter("category is not null").select(F.col("category").alias("label"), F.col("itemid").alias("item")))
    simple = {r[0]: [] for r in c.select("label").collect()}  # a dictionary of labels
    return spark.createDataFrame(M.expand_rules(c, simple, {"Labs": []}), "item bigint, label string, pos int, grp int, name string, pretty string")


@query(f"with {CODE}, s(category, short, colour) as (values ('ECONOMY', 'eco', 'green'), ('LARGE', 'l', 'red'), ('SMALL', null, 'blue')) select distinct code.code, coalesce(s.short, code.l1) as short, s.colour from code left join s on s.category = code.l1")
def code_styles(spark: SparkSession, d: str) -> DataFrame:
    """Short name and colour of each code's first level."""
    styles = spark.createDataFrame([("ECONOMY", "eco", "green"), ("LARGE", "l", "red"), ("SMALL", None, "blue")], "category string, short string, colour string")
    return T.styled(code(spark, d).select("code", F.col("l1").alias("ancestor")).distinct(), styles).select("code", "short", "colour")


#: Fisher's two-sided p-value in SQL, of rows with the counts a, b, c and d under a key.
def _fisher(cells: str, key: str) -> str:
    return f"""given as (select *, (a + b)::double as r1, (a + c)::double as c1, (a + b + c + d)::double as t from {cells}),
terms as (select *, unnest(range(cast(greatest(0, r1 + c1 - t) as bigint), cast(least(r1, c1) as bigint) + 1))::double as x from given),
logs as (select *, lgamma(r1 + 1) + lgamma(t - r1 + 1) + lgamma(c1 + 1) + lgamma(t - c1 + 1) - lgamma(t + 1) - lgamma(x + 1) - lgamma(r1 - x + 1) - lgamma(c1 - x + 1) - lgamma(t - r1 - c1 + x + 1) as lp from terms),
heres as (select *, max(case when x = a then lp end) over (partition by {key}) as here from logs),
tested as (select {key}, a, b, c, d, least(1.0::double, sum(case when lp <= here + 1e-7 then exp(lp) else 0 end)) as p_value from heres group by {key}, a, b, c, d)"""


_TESTED = f"""{_SETS}, {ENC}, labelled as (select i.enc, e.lab, list(i.item) as items from items i join enc e using (enc) group by 1, 2),
size as (select lab, count(*) as size from labelled group by 1), t as (select count(*) as n_all from labelled),
hit as (select l.lab, f.itemset, count(*) as a from labelled l join freq f on list_has_all(l.items, f.itemset) group by 1, 2),
tot as (select itemset, sum(a) as n_set from hit group by 1),
cells as (select s.lab, tot.itemset, coalesce(a, 0) as a, size - coalesce(a, 0) as b, n_set - coalesce(a, 0) as c, n_all - size - n_set + coalesce(a, 0) as d
  from tot cross join size s cross join t left join hit on hit.lab = s.lab and hit.itemset = tot.itemset),
{_fisher('cells', 'lab, itemset')},
enriched as (select *, a / (a + b)::double as support, case when c + d > 0 then c / (c + d)::double end as complement_support, p_value <= 0.01::double / (select count(*) from cells) as significant from tested)"""


@query(
    f"""with {_TESTED},
placed as (select *, row_number() over (partition by lab order by support desc, cast(itemset as varchar)) as place from enriched),
shown as (select *, least(greatest(coalesce(max(case when significant then place end) over (partition by lab), 0), 7), 20) as k from placed)
select lab, cast(place as int) as place, case when len(itemset) = 1 then itemset[1] else '(' || len(itemset) || ') [' || array_to_string(itemset, ', ') || ']' end as itemset,
  round(support, 6) as support, round(complement_support, 6) as complement_support, round(support / complement_support, 6) as factor, round(p_value, 8) as p_value, significant from shown where place <= k"""
)
def itemset_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """The listing of enriched sets of each cluster with Fisher's test."""
    e = I.listing(_enriched(spark, d), "lab")
    return e.select("lab", "place", I.itemset_text().alias("itemset"), F.round("support", 6).alias("support"), F.round("complement_support", 6).alias("complement_support"), F.round("factor", 6).alias("factor"), F.round("p_value", 8).alias("p_value"), "significant")


@query(f"with {_TESTED} select round(p_value, 8) as p_value from tested")
def itemset_p_values(spark: SparkSession, d: str) -> DataFrame:
    """All p-values of the analysis in one column."""
    return I.p_values(_enriched(spark, d)).select(F.round("p_value", 8).alias("p_value"))


@query(
    f"""with {CODE}, {ENC}, has as (select distinct l1 as code, enc from code), n as (select h.code, e.lab, count(*) as a from has h join enc e using (enc) group by 1, 2),
every as (select code, sum(a) as n_code from n group by 1), size as (select lab, count(*) as size from enc group by 1), t as (select count(*) as n_all from enc),
cells as (select s.lab, v.code, coalesce(a, 0) as a, size - coalesce(a, 0) as b, n_code - coalesce(a, 0) as c, n_all - size - n_code + coalesce(a, 0) as d from every v cross join size s cross join t left join n on n.code = v.code and n.lab = s.lab),
{_fisher('cells', 'lab, code')} select lab, code, cast(a as bigint) as a, cast(b as bigint) as b, cast(c as bigint) as c, cast(d as bigint) as d, round(p_value, 8) as p_value from tested"""
)
def code_membership_test(spark: SparkSession, d: str) -> DataFrame:
    """Having a category of codes at all, each cluster against the others."""
    c = code(spark, d).select("enc", F.col("l1").alias("code"))
    return X.membership_test(c, enc(spark, d).select("enc", "lab"), "lab").withColumn("p_value", F.round("p_value", 8))


@query(
    f"""with {_SETS}, {ENC}, labelled as (select i.enc, e.lab, list(i.item order by i.item) as items from items i join enc e using (enc) group by 1, 2),
size as (select lab, count(*)::double as size from labelled group by 1),
inside as (select l.lab, f.itemset from labelled l join allsets f on list_has_all(l.items, f.itemset) group by 1, 2 having count(*) >= 0.05::double * (select size from size s where s.lab = l.lab)),
maxin as (select itemset from inside f where not exists (select 1 from inside g where g.lab = f.lab and len(g.itemset) > len(f.itemset) and list_has_all(g.itemset, f.itemset))),
maxall as (select itemset from freq f where not exists (select 1 from freq g where len(g.itemset) > len(f.itemset) and list_has_all(g.itemset, f.itemset)))
select array_to_string(itemset, '|') as itemset from (select itemset from maxin union select itemset from maxall union select itemset from s1)"""
)
def united_itemsets(spark: SparkSession, d: str) -> DataFrame:
    """Maximal frequent sets of the population and of each cluster with all single items, once each."""
    return I.all_sets(_tx(spark, d), 0.05, "lab").select(F.array_join("itemset", "|").alias("itemset"))


_PAIRED = f"""{_LONG}, tab as (select x.clustering_id as l, y.clustering_id as r, x.label as a, y.label as b, count(*)::double as n from long x join long y on x.id = y.id and x.clustering_id < y.clustering_id group by all),
tot as (select l, r, sum(n) as t, sum(n * (n - 1) / 2) as sab from tab group by 1, 2), sa as (select l, r, sum(n * (n - 1) / 2) as sa, sum(m) as ma from (select l, r, a, sum(n) as n, max(n) as m from tab group by 1, 2, 3) group by 1, 2),
sb as (select l, r, sum(n * (n - 1) / 2) as sb, sum(m) as mb from (select l, r, b, sum(n) as n, max(n) as m from tab group by 1, 2, 3) group by 1, 2),
j as (select l, r, (sab - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)) as ari, least(ma, mb) / t as jaccard from tot join sa using (l, r) join sb using (l, r))"""


@query(f"with {_PAIRED} select l as left_id, r as right_id, round(ari, 6) as ari, round(jaccard, 6) as jaccard from j")
def pairwise_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Every two clusterings of the points."""
    p = A.pairwise_similarity(_long(spark, d))
    return p.select("left_id", "right_id", F.round("ari", 6).alias("ari"), F.round("jaccard", 6).alias("jaccard"))


@query(f"with {_PAIRED} select 'a' as first, 'b' as second, 'c' as third, round(avg((ari + jaccard) / 2), 6) as score from j")
def triple_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Every three clusterings of the points, by the mean of two scores of their pairs."""
    p = A.pairwise_similarity(_long(spark, d)).withColumn("sim_score", (F.col("ari") + F.col("jaccard")) / 2)
    return A.triple_similarity(p).select("first", "second", "third", F.round("sim_score", 6).alias("score"))


@query()
def error_variance_test(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of variance and error of the series with its p-value."""
    return X.correlation(R.series_errors(R.series_mean_reconstruction(minutes(spark, d))), "variance", "mse")


@query()
def pca_likelihood(spark: SparkSession, d: str) -> DataFrame:
    """Mean log-likelihood of training and validation points under components fitted on the first."""
    v = split(vectors(spark, d), "id", 1, 0.9)
    train, rest = v.filter("split = 'training'"), v.filter("split = 'validation'")
    c = P.Components(46).fit(train)
    return c.log_likelihood(train).withColumn("split", F.lit("training")).unionByName(c.log_likelihood(rest).withColumn("split", F.lit("validation")))


def _dictionary(df: DataFrame, column: str, most: int = 1000) -> list[str]:
    """The distinct values of a column that is a dictionary; refused if it is longer."""
    rows = df.select(column).na.drop().distinct().orderBy(column).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} values")
    return [r[0] for r in rows]


def _attributes(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, list[str]]]:
    """Encounters with attributes of five kinds, each an array column: levels and trends of the signals, static
    numbers, and the presence of codes at two levels; and the eight selections of them."""
    from cohortloom.operators.series import trend_angle

    m = minutes(spark, d)
    items = F.array(*[F.lit(i) for i in _dictionary(m, "item")])

    def signals(df: DataFrame, value: str, name: str) -> DataFrame:
        cells = df.groupBy("enc").agg(F.map_from_entries(F.collect_list(F.struct("item", value))).alias("_m"))
        return cells.select("enc", F.transform(items, lambda i: F.col("_m")[i]).alias(name))

    wide = table(spark, d, "customer").select(F.col("c_custkey").alias("enc"), F.array(F.col("c_acctbal"), F.col("c_nationkey").cast("double")).alias("static"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("y"))
    wide = wide.join(signals(m.groupBy("enc", "item").agg(F.avg("value").alias("v")), "v", "levels"), "enc", "left")
    wide = wide.join(signals(trend_angle(m.select("enc", "item", "t", "value")), "angle", "trends"), "enc", "left")
    owner = table(spark, d, "orders").select(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("owner"))
    codes = code(spark, d).join(owner, F.col("enc") == F.col("order")).select(F.col("owner").alias("enc"), "l1", "l2")
    for name, column in (("codes_first", "l1"), ("codes_second", "l2")):
        kinds = F.array(*[F.lit(k) for k in _dictionary(codes, column)])
        held = codes.groupBy("enc").agg(F.collect_set(column).alias("_c"))
        wide = wide.join(held, "enc", "left").withColumn(name, F.transform(kinds, lambda k: F.coalesce(F.array_contains("_c", k), F.lit(False)).cast("double"))).drop("_c")
    none = F.transform(items, lambda i: F.lit(None).cast("double"))
    wide = wide.withColumns({c: F.coalesce(c, none) for c in ("levels", "trends")})
    return settled(wide), {
        "all": ["levels", "trends", "static", "codes_first", "codes_second"],
        "codes": ["codes_first", "codes_second"],
        "codes_first": ["codes_first"],
        "codes_second": ["codes_second"],
        "static": ["static"],
        "levels": ["levels"],
        "trends": ["trends"],
        "series": ["levels", "trends"],
    }


@query()
def tree_selections(spark: SparkSession, d: str) -> DataFrame:
    """Trees over eight selections of attributes."""
    wide, selections = _attributes(spark, d)
    return P.tree_selections(wide, "y", selections, gains=(*P.GAINS, 2**-10))


@query()
def category_classifiers(spark: SparkSession, d: str) -> DataFrame:
    """A classifier on the features for each label."""
    v = vectors(spark, d)
    labels = _dictionary(v, "label", 100)
    v = split(v.select("id", "features", *[(F.col("label") == k).cast("int").alias(f"is_{k}") for k in labels]), "id", 1, 0.8)
    return P.classify_each(v.filter("split = 'training'"), v.filter("split = 'validation'"), [f"is_{k}" for k in labels])


@query()
def cluster_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Sweep, bootstraps, robustness and choice of clusterings in one call, for k-medoids with 2 to 12 clusters
    and five bootstraps (bootstrap_robustness has the whole range)."""
    return K.cluster_complete(vectors(spark, d).select("id", "features"), ("kmedoids",), list(range(2, 13)), 5)[2]
