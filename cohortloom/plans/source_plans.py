"""Queries through sinks and sources: what is written to the shared folder and read again must be the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators.support import relative_support
from cohortloom.plans.registry import query
from cohortloom.plans.views import EV, ev
from cohortloom.sources import readers as R
from cohortloom.sources import sinks as K
from cohortloom.sources.tables import shared_folder, table


@query(f"with {EV} select enc, item, ts, value, event_id from ev")
def charts_written(spark: SparkSession, d: str) -> DataFrame:
    """Charts by bucket of the encounter."""
    path = f"{shared_folder(spark)}/charts"
    K.charts(ev(spark, d), path)
    return spark.read.parquet(path).select("enc", "item", "ts", "value", "event_id")


@query("select c_custkey as enc, case when c_acctbal < 0 then 0.0::double else c_acctbal end as num from customer")
def static_upserted(spark: SparkSession, d: str) -> DataFrame:
    """A static table whose negative numbers a second delivery replaces."""
    path = f"{shared_folder(spark)}/static"
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("enc"), F.col("c_acctbal").alias("num"))
    K.upsert_parquet(c, path, "enc")
    K.upsert_parquet(c.filter("num < 0").withColumn("num", F.lit(0.0)), path, "enc")
    return R.read_upserted(spark, path)


@query("select hadm_id, diagnosis from admissions")
def documents_written(spark: SparkSession, d: str) -> DataFrame:
    """Rows as JSON documents; absent or whole."""
    path = f"{shared_folder(spark)}/json"
    assert R.read_or_none(spark, path, "json") is None
    K.json_rows(table(spark, d, "admissions").select("hadm_id", "diagnosis"), path)
    return R.read_or_none(spark, path, "json").select("hadm_id", "diagnosis")


@query("select c_mktsegment as cat, count(*) as n, round(avg(c_acctbal), 6) as mean from customer group by 1")
def summary_written(spark: SparkSession, d: str) -> DataFrame:
    """A summary table as one CSV file."""
    path = f"{shared_folder(spark)}/summary"
    s = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("cat")).agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 6).alias("mean"))
    K.csv_table(s, path)
    return spark.read.option("header", True).schema("cat string, n bigint, mean double").csv(path)


@query("select category, label, itemid from d_items where category is not null")
def categories_written(spark: SparkSession, d: str) -> DataFrame:
    """Rows in one CSV folder for each category."""
    path = f"{shared_folder(spark)}/categories"
    K.csv_by(table(spark, d, "d_items").filter("category is not null").select("category", "label", "itemid"), path, "category")
    return spark.read.option("header", True).schema("label string, itemid bigint, category string").csv(path)


@query("select vec_id as id, cast(label as int) as label, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings")
def projection_written(spark: SparkSession, d: str) -> DataFrame:
    """Projected points as JSON."""
    path = f"{shared_folder(spark)}/points"
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"), F.slice(F.col("embedding").cast("array<double>"), 1, 3).alias("features"))
    K.projection_json(v, path)
    return spark.read.schema("id bigint, label int, x double, y double, z double").json(path)


@query(f"with {EV}, t as (select count(distinct enc)::double as n from ev) select item, count(distinct enc) as n_enc, round(count(distinct enc) / any_value(n), 6) as support from ev, t where value is not null group by item")
def support_written(spark: SparkSession, d: str) -> DataFrame:
    """Support of each signal as JSON."""
    path = f"{shared_folder(spark)}/support"
    K.support_statistics(relative_support(ev(spark, d).filter("value is not null")).withColumn("support", F.round("support", 6)), path)
    return spark.read.schema("item string, n_enc bigint, support double").json(path)


@query("select cast(n_nationkey as varchar) as value from nation")
def text_written(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_folder(spark)}/text"
    K.text(table(spark, d, "nation"), path, "n_nationkey")
    return spark.read.text(path)


@query("select n_regionkey::bigint as enc, n_nationkey::double as t, unnest(['size', 'code']) as item, unnest([length(n_name)::double, case when n_nationkey % 2 = 0 then n_nationkey * 1.5::double end]) as value from nation")
def csv_folder_events(spark: SparkSession, d: str) -> DataFrame:
    """A folder with one CSV file for each encounter, read as long events; empty cells are missing values."""
    path = f"{shared_folder(spark)}/encounters"
    n = table(spark, d, "nation")
    line = F.concat_ws(",", F.col("n_nationkey").cast("string"), F.length("n_name").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, (F.col("n_nationkey") * 1.5).cast("string")).otherwise(""))
    files = n.groupBy("n_regionkey").agg(F.array_join(F.concat(F.array(F.lit("time,size,code")), F.sort_array(F.collect_list(line))), "\n").alias("text"))
    K.named_files(files.select(F.concat(F.lit("encounter_"), "n_regionkey", F.lit(".csv")).alias("name"), "text"), path)
    return R.csv_folder(spark, path, "time")


@query("select r_regionkey::bigint as enc from region")
def finished_files(spark: SparkSession, d: str) -> DataFrame:
    """Ids of finished encounters from the names of their files."""
    path = f"{shared_folder(spark)}/done"
    K.named_files(table(spark, d, "region").select(F.concat(F.lit("chart_"), "r_regionkey", F.lit(".json")).alias("name"), F.lit("{}").alias("text")), path)
    return R.finished_ids(spark, path, "*.json")


@query("select sha256(r_name) as sha from region")
def file_digests(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_folder(spark)}/files"
    K.named_files(table(spark, d, "region").select(F.concat(F.lit("f"), "r_regionkey").alias("name"), F.col("r_name").alias("text")), path)
    return R.file_identity(spark, path).select("sha")


@query("select r_regionkey::bigint as run, 'finished ' || r_name as line from region")
def log_last_lines(spark: SparkSession, d: str) -> DataFrame:
    """Last line of each run's log, trailing blanks apart."""
    path = f"{shared_folder(spark)}/logs"
    body = F.concat(F.lit("epoch 1\nepoch 2\nfinished "), "r_name", F.lit("\n\n"))
    K.named_files(table(spark, d, "region").select(F.concat(F.lit("run_"), "r_regionkey", F.lit(".log")).alias("name"), body.alias("text")), path)
    return R.run_logs(spark, f"{path}/*.log").select(R.file_id(F.col("path")).alias("run"), "line")


@query("select n_nationkey as id, n_name as name from nation")
def table_read_through(spark: SparkSession, d: str) -> DataFrame:
    """A table that is made once and then read."""
    path = f"{shared_folder(spark)}/nation"
    make = lambda: table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    R.read_through(spark, path, make)
    return R.read_through(spark, path, lambda: make().limit(0))


@query(f"with {EV} select event_id, enc, item, value from ev where enc in (select c_custkey from customer where c_acctbal > 5000)")
def cohort_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of the encounters of a cohort, by a semi-join."""
    cohort = table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("enc"))
    return R.events_of(ev(spark, d), cohort).select("event_id", "enc", "item", "value")


@query(
    """with n as (select cast(n_nationkey as varchar) as code, n_name, r_name from nation join region on r_regionkey = n_regionkey)
select code, 0 as depth, 'all' as ancestor from n union all select code, 1, r_name from n union all select code, 2, n_name from n"""
)
def code_tree_file(spark: SparkSession, d: str) -> DataFrame:
    """A code tree from a file with paths and comments."""
    path = f"{shared_folder(spark)}/tree"
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = n.agg(F.array_join(F.concat(F.array(F.lit("# codes"), F.lit("code,path")), F.sort_array(F.collect_list(F.concat(F.col("n_nationkey").cast("string"), F.lit(",all|"), "r_name", F.lit("|"), "n_name")))), "\n").alias("text"))
    K.named_files(lines.withColumn("name", F.lit("tree.csv")), path)
    return R.code_tree(spark, f"{path}/tree.csv")


@query("select lpad(cast(n_nationkey as varchar), 4, '0') as code, n_nationkey % 3 = 1 as chronic from nation")
def chronic_codes_file(spark: SparkSession, d: str) -> DataFrame:
    """Chronic conditions from a quoted file with a title."""
    path = f"{shared_folder(spark)}/chronic"
    line = F.format_string("'%s ','%s','%s'", F.lpad(F.col("n_nationkey").cast("string"), 4, "0"), "n_name", F.when(F.col("n_nationkey") % 3 == 1, "1").otherwise("0"))
    lines = table(spark, d, "nation").agg(F.array_join(F.concat(F.array(F.lit("'table',,"), F.lit("'CODE','NAME','CHRONIC'")), F.sort_array(F.collect_list(line))), "\n").alias("text"))
    K.named_files(lines.withColumn("name", F.lit("chronic.csv")), path)
    return R.chronic_codes(spark, f"{path}/chronic.csv")


@query(f"with {EV} select enc, count(*) as n, any_value(c_mktsegment) as cat from ev join customer on c_custkey = enc where c_mktsegment in ('BUILDING', 'MACHINERY') and value > 0 group by enc")
def own_extractor(spark: SparkSession, d: str) -> DataFrame:
    """An extractor over frames with overridden hooks: only positive values, only two segments."""

    class Positive(R.FrameExtractor):
        def preprocess_events(self, events: DataFrame) -> DataFrame:
            return events.filter("value > 0")

        def postprocess_static(self, static: DataFrame) -> DataFrame:
            return static.filter("cat in ('BUILDING', 'MACHINERY')")

    c = table(spark, d, "customer").select(F.col("c_custkey").alias("enc"), F.col("c_mktsegment").alias("cat"))
    x = Positive(ev(spark, d), c)
    static = x.static(x.encounters())
    return x.events(static).groupBy("enc").agg(F.count("*").alias("n")).join(static, "enc")
