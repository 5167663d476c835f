"""Canonical views: the same projections in Spark and in SQL.

ev: event log of encounters (user) and signals (event type) with two sources; evd: the same by day, where both
sources meet; adm: first event as admission; enc: static record with labels; code: codes with a three-level
tree; lab2: labelings of the embedded points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.sources.tables import table


def ev(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("enc"), F.col("event_type").alias("item"), "ts", "value", (F.col("event_id") % 2 == 1).alias("trusted"), "event_id")


def evd(spark: SparkSession, d: str) -> DataFrame:
    return ev(spark, d).withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))


def adm(spark: SparkSession, d: str) -> DataFrame:
    return ev(spark, d).groupBy("enc").agg(F.min("ts").alias("admit"))


def minutes(spark: SparkSession, d: str) -> DataFrame:
    """Events with whole minutes since admission: enc, item, t, value, event_id."""
    from cohortloom.operators.events import minutes_since

    return minutes_since(ev(spark, d), adm(spark, d)).select("enc", "item", "t", "value", "event_id")


def enc(spark: SparkSession, d: str) -> DataFrame:
    """Encounters: orders with their customer."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("enc"),
        F.col("o_custkey").alias("subject"),
        F.col("o_orderdate").alias("admit"),
        F.col("c_acctbal").alias("num"),
        F.col("o_totalprice").alias("price"),
        F.col("c_mktsegment").alias("cat"),
        (F.col("o_orderstatus") == "F").alias("died"),
        (F.col("c_nationkey") % 5).cast("int").alias("lab"),
    )


def code(spark: SparkSession, d: str) -> DataFrame:
    """Codes of an encounter with the names of levels 1 and 2 of their tree."""
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    return li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("enc"), F.col("p_type").alias("l1"), F.concat_ws("/", "p_type", "p_brand").alias("l2"), F.col("p_partkey").cast("string").alias("code"))


def stay(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("enc")).agg(F.min("l_shipdate").alias("s"), F.max("l_shipdate").alias("e"))


def lab2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("a"), (F.col("vec_id") % 7).cast("int").alias("b"), (F.col("vec_id") % 3).cast("int").alias("c"))


EV = "ev as (select user_id as enc, event_type as item, ts, value, event_id % 2 = 1 as trusted, event_id from events)"
EVD = EV + ", evd as (select enc, item, cast(date_trunc('day', ts) as timestamp) as ts, value, trusted from ev)"
ADM = EV + ", adm as (select enc, min(ts) as admit from ev group by enc)"
MIN = ADM + ", mins as (select enc, item, cast(floor((epoch_us(ts) - epoch_us(admit)) / 60000000.0) as bigint) as t, value, event_id from ev join adm using (enc))"
ENC = """enc as (select o_orderkey as enc, o_custkey as subject, o_orderdate as admit, c_acctbal as num, o_totalprice as price,
  c_mktsegment as cat, o_orderstatus = 'F' as died, cast(c_nationkey % 5 as int) as lab from orders join customer on c_custkey = o_custkey)"""
CODE = "code as (select l_orderkey as enc, p_type as l1, p_type || '/' || p_brand as l2, cast(p_partkey as varchar) as code from lineitem join part on p_partkey = l_partkey)"
STAY = "stay as (select l_orderkey as enc, min(l_shipdate) as s, max(l_shipdate) as e from lineitem group by 1)"
LAB2 = "lab2 as (select vec_id as id, cast(label as int) as a, cast(vec_id % 7 as int) as b, cast(vec_id % 3 as int) as c from embeddings)"
