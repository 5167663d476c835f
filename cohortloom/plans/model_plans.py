"""Queries over features, clusterings, models and search runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators import clustering as K
from cohortloom.operators import features as P
from cohortloom.operators import search as H
from cohortloom.operators import similarity as A
from cohortloom.operators.cohort import bootstraps
from cohortloom.plans.registry import query
from cohortloom.plans.views import CODE, ENC, EV, LAB2, MIN, code, enc, ev, lab2, minutes
from cohortloom.sources.tables import table

_ITEMS = ["click", "error", "purchase", "signup", "view"]


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), F.col("label").cast("int").alias("label"))


_W = f"""{EV}, s as (select c_custkey as enc, c_acctbal as bal, cast(c_nationkey as double) as nation from customer),
w as (select s.enc, any_value(bal) as bal, any_value(nation) as nation, {', '.join(f"avg(value) filter (item = '{i}') as {i}" for i in _ITEMS)} from s left join ev using (enc) group by s.enc)"""
_COLS = ["bal", "nation", *_ITEMS]


@query(
    f"""with {_W}, m as (select {', '.join(f'quantile_cont({c}, 0.5) as {c}' for c in _COLS)} from w),
f as (select w.enc, {', '.join(f'coalesce(w.{c}, m.{c}, 0) as {c}' for c in _COLS)} from w, m),
p as (select {', '.join(f'avg({c}) as m_{c}, stddev_pop({c}) as s_{c}' for c in _COLS)} from f)
select enc, {', '.join(f'round(({c} - m_{c}) / case when s_{c} > 0 then s_{c} else 1 end, 6) as {c}' for c in _COLS)} from f, p"""
)
def baseline_matrix(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("enc"), F.col("c_acctbal").alias("bal"), F.col("c_nationkey").cast("double").alias("nation"))
    m = P.baseline_matrix(ev(spark, d), _ITEMS, s, ["bal", "nation"])
    return m.select("enc", *[F.round(c, 6).alias(c) for c in _COLS])


_L1 = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(f"with {CODE}, {ENC} select e.enc, {', '.join(f'cast(count(*) filter (l1 = $q{v}$q) > 0 as int)::double as {v}'.replace('$q', chr(39)) for v in _L1)} from enc e left join code using (enc) group by 1")
def code_onehot(spark: SparkSession, d: str) -> DataFrame:
    return P.one_hot(code(spark, d), enc(spark, d), "l1", _L1)


@query(
    """with new as (select vec_id as id, label + 100 as label from embeddings where label >= 5), old as (select vec_id as id, label from embeddings where label <= 6)
select id, cast(label as int) as label from new union all select id, cast(label as int) from old where id not in (select id from new)"""
)
def feature_upsert(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).select("id", "label")
    return P.upsert(v.filter("label >= 5").withColumn("label", (F.col("label") + 100).cast("int")), v.filter("label <= 6"), "id")


@query("with n as (select label, count(*) as n from embeddings group by label) select cast(label as int) as label, n, round(sum(n) over () / (count(*) over () * n::double), 6) as weight from n")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return P.class_weights(vectors(spark, d), "label").withColumn("weight", F.round("weight", 6))


@query("select round(avg(case when x = 0 then 1.0 else 0.0 end), 6) as sparsity from (select unnest(embedding) as x from embeddings)")
def feature_sparsity(spark: SparkSession, d: str) -> DataFrame:
    return P.sparsity(vectors(spark, d)).withColumn("sparsity", F.round("sparsity", 6))


@query(
    f"""with {MIN}, s as (select enc, item, list(value order by t, value) as xs from mins group by 1, 2), e as (select enc, (row_number() over (order by enc) - 1) // 4 as batch from (select distinct enc from mins)),
p as (select batch, enc, item, xs, max(len(xs)) over (partition by batch) as l from s join e using (enc)),
c as (select *, unnest(range((l - 1) // 1024 + 1)) as chunk from p),
w as (select *, least(1024, l - chunk * 1024) as wide, xs[chunk * 1024 + 1:chunk * 1024 + 1024] as part from c)
select batch, enc, item, cast(len(xs) as int) as n, cast(chunk as int) as chunk, array_to_string(list_transform(part || list_transform(range(wide - len(part)), lambda i: -1.0::double), lambda x: cast(round(x * 100) as bigint)), ',') as xs from w"""
)
def padded_series(spark: SparkSession, d: str) -> DataFrame:
    """All readings of every series, padded to the longest series of a batch of four encounters."""
    p = P.padded_batches(minutes(spark, d), -1.0)
    return p.withColumn("xs", F.array_join(F.transform("xs", lambda x: F.round(x * 100).cast("long").cast("string")), ","))


@query()
def pca_features(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return P.Components(16).fit(v).transform(v)


@query()
def pca_reconstruction(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    c = P.Components(46).fit(v)
    back = c.inverse(c.transform(v)).withColumnRenamed("features", "rec")
    err = F.aggregate(F.zip_with("features", "rec", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return v.join(back, "id").select("id", (err / F.size("features")).alias("mse"))


@query()
def pca_explained(spark: SparkSession, d: str) -> DataFrame:
    return P.Components(46).fit(vectors(spark, d)).cumulative(spark)


_POINTS = "pts as (select vec_id as id, label, list_transform(embedding, lambda x: x::double) as v from embeddings)"


@query(
    f"""with {_POINTS}, x as (select id, label, unnest(v) as v, unnest(range(len(v))) as dim from pts), c as (select label, dim, avg(v) as c, count(*) as n from x group by 1, 2), g as (select dim, avg(v) as g from x group by 1),
b as (select sum(n * (c - g) * (c - g)) as b from c join g using (dim)), dd as (select x.label, id, sum((v - c) * (v - c)) as sq from x join c using (label, dim) group by 1, 2), w as (select sum(sq) as w, count(*) as n, count(distinct label) as k from dd),
s as (select label, avg(sqrt(sq)) as s from dd group by 1), m as (select a.label as a, z.label as z, sqrt(sum((a.c - z.c) * (a.c - z.c))) as m from c a join c z using (dim) where a.label <> z.label group by 1, 2),
r as (select m.a, max((sa.s + sz.s) / m) as r from m join s sa on sa.label = m.a join s sz on sz.label = m.z group by 1)
select round(b * (n - k) / (w * (k - 1)), 4) as calinski_harabasz, round(-(select avg(r) from r), 6) as davies_bouldin from b, w"""
)
def technical_quality(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return K.technical_quality(v.select("id", "features"), v.select("id", "label")).select(F.round("calinski_harabasz", 4).alias("calinski_harabasz"), F.round("davies_bouldin", 6).alias("davies_bouldin"))


@query(
    f"""with {_POINTS}, n as (select label, count(*) as n from pts group by 1), dist as (select a.id, a.label, b.label as other, sum(list_distance(a.v, b.v)) as s from pts a cross join pts b group by all),
o as (select dist.id, min(s / n.n) as b from dist join n on n.label = dist.other where dist.other <> dist.label group by 1), w as (select dist.id, s / greatest(n.n - 1, 1) as a from dist join n on n.label = dist.label where dist.other = dist.label)
select round(avg((b - a) / greatest(a, b)), 6) as silhouette from o join w using (id)"""
)
def silhouette(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return K.silhouette(v.select("id", "features"), v.select("id", "label")).select(F.round("silhouette", 6).alias("silhouette"))


def _quality(spark: SparkSession, d: str) -> DataFrame:
    l = lab2(spark, d)
    parts = None
    for c in "abc":
        p = l.select("id", F.lit(c).alias("clustering_id"), F.col(c).alias("label"))
        parts = p if parts is None else parts.unionByName(p)
    return A.label_quality(parts)


_Q = f"""{LAB2}, long as (select id, 'a' as clustering_id, a as label from lab2 union all select id, 'b', b from lab2 union all select id, 'c', c from lab2),
n as (select clustering_id, label, count(*) as n from long group by 1, 2), p as (select *, n / sum(n) over (partition by clustering_id) as p from n),
q as (select clustering_id, count(*) as k, exp(-sum(p * ln(p))) as k_effective from p group by 1)"""


@query(f"with {_Q} select clustering_id, k from q qualify row_number() over (partition by k order by abs(k - k_effective), clustering_id) = 1")
def pick_one_per_k(spark: SparkSession, d: str) -> DataFrame:
    return K.pick_one_per_k(_quality(spark, d)).select("clustering_id", "k")


@query(
    f"""with {_Q}, s as (select clustering_id, k, 'k' as metric, k::double as score from q union all select clustering_id, k, 'gap', -abs(round(k - k_effective, 9)) from q),
t as (select *, row_number() over (partition by metric order by score desc, clustering_id) <= ceil(0.5 * count(*) over (partition by metric)) as top, k = min(k) over () as least from s)
select distinct clustering_id, k from t where top or least"""
)
def pick_interesting(spark: SparkSession, d: str) -> DataFrame:
    q = _quality(spark, d)
    s = q.select("clustering_id", "k", F.lit("k").alias("metric"), F.col("k").cast("double").alias("score")).union(q.select("clustering_id", "k", F.lit("gap"), -F.abs(F.round(F.col("k") - F.col("k_effective"), 9))))
    return K.pick_interesting(s)


@query("select cast(label as int) as label, count(*) as n from embeddings group by 1 order by n desc, label desc limit 4")
def largest_clusters(spark: SparkSession, d: str) -> DataFrame:
    return K.top_labels(vectors(spark, d), 4)


@query()
def kmeans_sweep(spark: SparkSession, d: str) -> DataFrame:
    return K.kmeans(vectors(spark, d), [2, 5, 10])


@query()
def kmedoids(spark: SparkSession, d: str) -> DataFrame:
    return K.sweep(vectors(spark, d), "kmedoids")


@query()
def hierarchical(spark: SparkSession, d: str) -> DataFrame:
    return K.sweep(vectors(spark, d), "hierarchical")


@query()
def density_clusters(spark: SparkSession, d: str) -> DataFrame:
    return K.sweep(vectors(spark, d), "density", ks=[4, 8], eps=1.0)


@query()
def bootstrap_robustness(spark: SparkSession, d: str) -> DataFrame:
    """k-medoids and hierarchical clustering with every number of clusters of the range, against ten bootstraps
    of 70 percent."""
    v = vectors(spark, d).select("id", "features")
    members = bootstraps(v, "id", 10, 0.7, 1)
    full = K.sweep(v, "kmedoids").unionByName(K.sweep(v, "hierarchical"))
    boots = K.sweep_boots(v, members, "kmedoids").unionByName(K.sweep_boots(v, members, "hierarchical"))
    return K.robustness(full.persist(), boots.persist())


@query()
def metric_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return K.sensitivity(vectors(spark, d).select("id", "label"), [0.0, 0.1, 0.25, 0.5, 1.0])


@query()
def tree_explain(spark: SparkSession, d: str) -> DataFrame:
    """Trees over all feature columns: the whole grid of depths and gains, and a smaller gain beyond it."""
    v = vectors(spark, d)
    names = [f"f{i}" for i in range(v.select(F.max(F.size("features"))).head()[0] or 0)]
    x = v.select((F.col("label") < 5).alias("y"), *[F.get("features", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return P.trees(x, "y", names, gains=(*P.GAINS, 2**-10))


@query()
def feature_classifier(spark: SparkSession, d: str) -> DataFrame:
    from cohortloom.operators.cohort import split

    v = split(vectors(spark, d).withColumn("y", (F.col("label") < 5).cast("int")), "id", 1, 0.8)
    return P.classify(v.filter("split = 'training'").drop("split"), v.filter("split = 'validation'").drop("split"), "y")


@query(
    """with l as (select doc_id, list_extract(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), -1) as line from documents where text is not null)
select doc_id, case when contains(lower(line), 'memory') then 'oom' when contains(lower(line), 'time limit') then 'timeout' when contains(lower(line), 'oxygen') then 'error' when contains(lower(line), 'family') then 'done' when contains(lower(line), 'nursing') then 'running' else 'unknown' end as state from l"""
)
def log_status(spark: SparkSession, d: str) -> DataFrame:
    states = [("oom", "memory"), ("timeout", "time limit"), ("error", "Oxygen"), ("done", "family"), ("running", "nursing")]
    docs = table(spark, d, "documents").filter("text is not null").withColumn("line", H.last_line("text"))
    return docs.select("doc_id", H.log_state("line", states).alias("state"))


@query(
    """with p as (select event_id, case event_id % 3 when 0 then json_extract_string(props, '$.k') when 1 then cast(value as varchar) when 2 then event_type end as x from events)
select event_id, try_cast(case when regexp_full_match(x, '-?[0-9]+') then x end as bigint) as as_int, case when regexp_full_match(x, '-?[0-9]+') then null else try_cast(x as double) end as as_float, case when x is null then 'NotSet' when try_cast(x as double) is null then x end as as_text from p"""
)
def typed_cast(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 3
    e = table(spark, d, "events").select("event_id", F.when(k == 0, F.get_json_object("props", "$.k")).when(k == 1, F.col("value").cast("string")).otherwise(F.col("event_type")).alias("x"))
    return e.select("event_id", H.typed("x").alias("t")).select("event_id", "t.*")


@query("(select o_orderkey as run, o_totalprice as objective, 'best' as side from orders order by 2, 1 limit 15) union all (select o_orderkey, o_totalprice, 'worst' from orders order by 2 desc, 1 limit 15)")
def best_and_worst_runs(spark: SparkSession, d: str) -> DataFrame:
    return H.best_and_worst(table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_totalprice").alias("objective")), 15)


@query(f"with {ENC} select enc as run, case when cat = 'BUILDING' then 10e6::double when num < 0 then 5000.0::double else num end as objective from enc")
def objective_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    r = enc(spark, d).select(F.col("enc").alias("run"), F.when(F.col("cat") == "BUILDING", "error").otherwise("done").alias("state"), F.when(F.col("num") >= 0, F.col("num")).alias("objective"))
    return H.objective(r).select("run", "objective")


@query()
def sampled_settings(spark: SparkSession, d: str) -> DataFrame:
    runs = H.sample_runs({"bottleneck": [16, 32, 46], "layers": [1, 2, 3], "rate": [0.001, 0.01]}, 50, 1)
    return spark.createDataFrame([(i, k, str(v)) for i, r in enumerate(runs) for k, v in r.items()], "run int, arg string, value string")


@query(
    f"""with {EV}, c as (select count(distinct enc) as n from ev) select n, 0.045::double * n * 500 as training_s, least(18000 + 3.0::double * n, 168000.0::double) as memory_mb from c"""
)
def run_estimates(spark: SparkSession, d: str) -> DataFrame:
    n = ev(spark, d).select("enc").distinct().count()
    e = H.run_estimates(n)
    return spark.createDataFrame([(n, e["training_s"], e["memory_mb"])], "n bigint, training_s double, memory_mb double")
