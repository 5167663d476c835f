"""Queries over static records, cohorts and code trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators import cohort as C
from cohortloom.operators import static as S
from cohortloom.operators import taxonomy as T
from cohortloom.plans.registry import query
from cohortloom.plans.views import CODE, ENC, STAY, code, enc, stay
from cohortloom.sources.tables import table


@query("select doc_id, lang from documents where lower(text) like '%oxygen%' and lower(text) like '%daughter%'")
def text_filter_all_terms(spark: SparkSession, d: str) -> DataFrame:
    return C.text_contains_all(table(spark, d, "documents"), "text", ["Oxygen", "daughter"]).select("doc_id", "lang")


@query("select hadm_id, diagnosis from admissions where lower(diagnosis) like '%failure%'")
def admission_text_filter(spark: SparkSession, d: str) -> DataFrame:
    return C.text_contains_all(table(spark, d, "admissions"), "diagnosis", ["Failure"]).select("hadm_id", "diagnosis")


def _admissions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "admissions").select("hadm_id", "subject_id", "admittime", "dischtime", "ethnicity", "diagnosis")


def _lists(spark: SparkSession, d: str) -> list[DataFrame]:
    return [
        S.codes_of(table(spark, d, "diagnoses_icd"), "hadm_id", "icd9_code", "diagnoses"),
        S.codes_of(table(spark, d, "procedures_icd"), "hadm_id", "icd9_code", "procedures"),
    ]


@query(
    """select a.hadm_id, a.subject_id, p.gender, coalesce(x.codes, '') as diagnoses, coalesce(y.codes, '') as procedures
from admissions a left join patients p using (subject_id)
left join (select hadm_id, string_agg(icd9_code, '|' order by icd9_code) as codes from diagnoses_icd where icd9_code is not null group by 1) x using (hadm_id)
left join (select hadm_id, string_agg(icd9_code, '|' order by icd9_code) as codes from procedures_icd where icd9_code is not null group by 1) y using (hadm_id)"""
)
def static_assembly(spark: SparkSession, d: str) -> DataFrame:
    s = S.assemble(_admissions(spark, d), table(spark, d, "patients"), _lists(spark, d))
    return s.select("hadm_id", "subject_id", "gender", F.array_join("diagnoses", "|").alias("diagnoses"), F.array_join("procedures", "|").alias("procedures"))


_SIZE = """moments as (select hadm_id, field_name, itemid, charttime, avg(valuenum) as v from chartevents join static_fields using (itemid) where valuenum is not null and valuenum <> 0 group by all),
per_item as (select hadm_id, field_name, itemid, quantile_cont(v, 0.5) as v from moments group by all),
per_field as (select hadm_id, field_name, quantile_cont(v, 0.5) as v from per_item group by all),
size as (select hadm_id, quantile_cont(case field_name when 'weight_kg' then v when 'weight_oz' then v / 35.274::double when 'weight_lb' then v / 2.2046::double end, 0.5) as weight_kg,
  quantile_cont(case field_name when 'height_cm' then v when 'height_in' then v * 2.54::double end, 0.5) as height_cm from per_field group by hadm_id)"""


def _size(spark: SparkSession, d: str) -> DataFrame:
    return S.median_of_medians(table(spark, d, "chartevents"), table(spark, d, "static_fields"))


@query(f"with {_SIZE} select hadm_id, round(weight_kg, 6) as weight_kg, round(height_cm, 6) as height_cm from size")
def unit_normalised_median(spark: SparkSession, d: str) -> DataFrame:
    return _size(spark, d).select("hadm_id", F.round("weight_kg", 6).alias("weight_kg"), F.round("height_cm", 6).alias("height_cm"))


@query(f"with {_SIZE} select hadm_id, round(weight_kg / ((height_cm / 100) * (height_cm / 100)), 6) as bmi from size where weight_kg is not null and height_cm is not null")
def body_mass_index(spark: SparkSession, d: str) -> DataFrame:
    return _size(spark, d).select("hadm_id", F.round(S.bmi("weight_kg", "height_cm"), 6).alias("bmi")).na.drop()


@query(
    """select hadm_id, round(coalesce(sum(case when intime is not null and outtime is not null then (epoch_us(outtime) - epoch_us(intime)) / 1000000.0::double / 86400 end), 0), 6) as days,
  count(case when intime is not null and outtime is not null then 1 end) as visits from icustays group by hadm_id"""
)
def stay_days_and_visits(spark: SparkSession, d: str) -> DataFrame:
    return S.stays_summary(table(spark, d, "icustays")).select("hadm_id", F.round("FUTURE_days_in_care", 6).alias("days"), F.col("FUTURE_icu_visits").alias("visits"))


@query("select hadm_id, coalesce(string_agg(distinct first_careunit, '__' order by first_careunit), '') as stations from icustays group by hadm_id")
def station_string(spark: SparkSession, d: str) -> DataFrame:
    return S.stations(table(spark, d, "icustays")).select("hadm_id", F.col("FUTURE_icu_stations").alias("stations"))


@query(
    """with u as (select hadm_id, first_careunit as c from icustays union select hadm_id, last_careunit from icustays)
select hadm_id, coalesce(string_agg(c, '__' order by c), '') as stations from u group by hadm_id"""
)
def station_string_both(spark: SparkSession, d: str) -> DataFrame:
    return S.stations(table(spark, d, "icustays"), both=True).select("hadm_id", F.col("FUTURE_icu_stations").alias("stations"))


@query("select hadm_id, round(least((epoch_us(admittime) - epoch_us(dob)) / 1000000.0::double / 86400 / 365.25::double, 89.0::double), 6) as age from admissions join patients using (subject_id)")
def age_and_cap(spark: SparkSession, d: str) -> DataFrame:
    return _admissions(spark, d).join(table(spark, d, "patients"), "subject_id").select("hadm_id", F.round(S.age_years("dob", "admittime"), 6).alias("age"))


@query(
    """select hadm_id, coalesce(not (dod <= admittime + interval 28 days), true) as survival, coalesce(not (dod <= dischtime), true) as survival_to_discharge,
  coalesce(not (dod > admittime + interval 28 days), true) as survival_all_time, dod is null as survived_ever from admissions left join patients using (subject_id)"""
)
def survival_flags(spark: SparkSession, d: str) -> DataFrame:
    a = _admissions(spark, d).join(table(spark, d, "patients"), "subject_id", "left")
    return a.select("hadm_id", *[c.alias(n.removeprefix(S.FUTURE)) for n, c in S.survival_flags("dod", "admittime", "dischtime").items()])


@query(
    """with e as (select hadm_id, upper(left(ethnicity, 1)) || lower(substr(ethnicity, 2)) as t, diagnosis from admissions),
f as (select hadm_id, split_part(split_part(t, '/', 1), ' - ', 1) as t, diagnosis from e)
select hadm_id, case when t = 'Multi race ethnicity' then 'Other' else t end as ethnicity,
  replace(replace(replace(trim(coalesce(diagnosis, 'No admission diagnosis')), '  ', ' '), '//', '/'), '\\\\', '\\') as diagnosis from f"""
)
def category_cleanup(spark: SparkSession, d: str) -> DataFrame:
    a = _admissions(spark, d).withColumn("diagnosis", S.diagnosis_text("diagnosis"))
    return a.select("hadm_id", S.ethnicity_group("ethnicity").alias("ethnicity"), S.canonical_text("diagnosis").alias("diagnosis"))


@query(
    """select distinct itemid, translate(label, ':/ ', '___') as file_name, list_aggregate(list_transform(string_split(replace(lower(label), '_', ' '), ' '), lambda x: upper(x[1]) || x[2:]), 'string_agg', ' ') as title from d_items"""
)
def item_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "d_items").select("itemid", S.sanitize("label").alias("file_name"), S.prettify("label").alias("title")).distinct()


@query("select distinct o_orderkey as enc from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def not_yet_extracted(spark: SparkSession, d: str) -> DataFrame:
    return C.not_yet(table(spark, d, "orders").select(F.col("o_orderkey").alias("enc")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("enc")))


_COHORT = """cohort as (select a.hadm_id as enc, least((epoch_us(admittime) - epoch_us(dob)) / 1000000.0::double / 86400 / 365.25::double, 89.0::double) as age_years,
  coalesce(i.days, 0) as days_in_care from admissions a join patients p using (subject_id)
  left join (select hadm_id, sum((epoch_us(outtime) - epoch_us(intime)) / 1000000.0::double / 86400) as days from icustays where intime is not null and outtime is not null group by 1) i on i.hadm_id = a.hadm_id)"""


def _cohort(spark: SparkSession, d: str) -> DataFrame:
    a = _admissions(spark, d).join(table(spark, d, "patients"), "subject_id").join(S.stays_summary(table(spark, d, "icustays")), "hadm_id", "left")
    return a.select(F.col("hadm_id").alias("enc"), S.age_years("dob", "admittime").alias("age_years"), F.coalesce("FUTURE_days_in_care", F.lit(0.0)).alias("days_in_care"))


@query(f"with {_COHORT} select enc, round(age_years, 6) as age_years from cohort where age_years >= 22")
def cohort_min_age(spark: SparkSession, d: str) -> DataFrame:
    return C.cohort(_cohort(spark, d), min_age=22).select("enc", F.round("age_years", 6).alias("age_years"))


@query(f"with {_COHORT} select enc, round(days_in_care, 6) as days_in_care from cohort where days_in_care <= 1")
def short_stay(spark: SparkSession, d: str) -> DataFrame:
    return C.cohort(_cohort(spark, d), named="bed_and_breakfast").select("enc", F.round("days_in_care", 6).alias("days_in_care"))


@query("select hadm_id as enc from admissions where hadm_id in (select hadm_id from diagnoses_icd) and hadm_id in (select hadm_id from procedures_icd) and hadm_id in (select hadm_id from icustays)")
def complete_cases(spark: SparkSession, d: str) -> DataFrame:
    key = lambda t: table(spark, d, t).select(F.col("hadm_id").alias("enc"))
    return C.complete(key("admissions"), [key("diagnoses_icd"), key("procedures_icd"), key("icustays")])


@query(
    """with l as (select 'gender' as attr, gender as value from patients union all select 'ethnicity', ethnicity from admissions union all select 'station', first_careunit from icustays),
c as (select attr, value, count(*) as n from l where value is not null group by 1, 2)
select attr, value, n, cast(dense_rank() over (partition by attr order by value) - 1 as int) as idx from c"""
)
def category_domain(spark: SparkSession, d: str) -> DataFrame:
    parts = [("patients", "gender", "gender"), ("admissions", "ethnicity", "ethnicity"), ("icustays", "first_careunit", "station")]
    frames = [S.category_domain(table(spark, d, t).withColumnRenamed(c, a), [a]) for t, c, a in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query(f"with {ENC}, c as (select 'cat' as attr, count(distinct cat) - 1 as max_idx from enc union all select 'lab', count(distinct lab) - 1 from enc) select attr, cast(max_idx as int) as max_idx from c")
def category_max_index(spark: SparkSession, d: str) -> DataFrame:
    return S.largest_index(S.category_domain(enc(spark, d), ["cat", "lab"]))


@query(
    f"""with {ENC}, {STAY} select enc, round(case when not died then (epoch_us(e) - epoch_us(s)) / 86400000000.0::double end, 6) as days_survivors,
  round(case when died then (epoch_us(e) - epoch_us(s)) / 86400000000.0::double end, 6) as days_deceased from enc join stay using (enc)"""
)
def days_by_survival(spark: SparkSession, d: str) -> DataFrame:
    x = enc(spark, d).join(stay(spark, d), "enc").withColumn("days", S.days_between("s", "e")).withColumn("alive", ~F.col("died"))
    return S.split_by_survival(x, "days", "alive").select("enc", F.round("days_survivors", 6).alias("days_survivors"), F.round("days_deceased", 6).alias("days_deceased"))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the part tree with their path; the code of a node is its part number."""
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").cast("string").alias("code"), F.array("p_type", F.concat_ws("/", "p_type", "p_brand"), F.col("p_partkey").cast("string")).alias("path"))


@query(
    """with tree as (select cast(p_partkey as varchar) as node, p_type as l1, p_type || '/' || p_brand as l2 from part),
used as (select distinct l_orderkey as enc, cast(l_partkey as varchar) || '.9' as code from lineitem),
cut as (select *, replace(code, '.', '') as c from used),
tries as (select c.enc, c.code, t.node, length(t.node) as k, t.l2 from cut c join tree t on starts_with(c.c, t.node) and (length(t.node) >= 3 or t.node = c.c)),
best as (select enc, code, arg_max(node, k) as node, arg_max(l2, k) as l2 from tries group by 1, 2)
select u.enc, u.code, b.node, coalesce(b.l2, 'UNKNOWN') as ancestor from used u left join best b using (enc, code)"""
)
def code_ancestor(spark: SparkSession, d: str) -> DataFrame:
    nodes = _tree(spark, d)
    codes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("enc"), F.concat(F.col("l_partkey").cast("string"), F.lit(".9")).alias("code")).distinct()
    found = T.resolve(codes, nodes.select(F.col("code").alias("node")))
    return T.ancestor_at(found, T.closure(nodes), 1).select("enc", "code", "node", "ancestor")


@query(
    """with c as (select distinct upper(regexp_replace(icd9_code, '[.\\s]', '', 'g')) as code from diagnoses_icd where icd9_code is not null)
select code, case when length(code) >= 3 then left(code, 3) end as chapter, 'DIAGNOSIS__' || code as name from c where code <> ''"""
)
def code_display_name(spark: SparkSession, d: str) -> DataFrame:
    codes = table(spark, d, "diagnoses_icd").select(F.upper(F.regexp_replace("icd9_code", "[.\\s]", "")).alias("code")).filter("code <> ''").distinct()
    chapter = F.when(F.length("code") >= 3, F.substring("code", 1, 3))
    return T.display_name(codes.withColumn("chapter", chapter).withColumn("name", F.lit(None).cast("string")), "DIAGNOSIS")


@query("select p_name as title, nullif(regexp_extract(p_partkey || ' ' || p_name, '^[0-9VE][0-9]\\S*'), '') as code from part")
def node_codes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("full", F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_name"))
    return p.select(F.col("p_name").alias("title"), T.node_code("full").alias("code"))


@query(f"with {CODE}, {ENC}, n as (select l1, l2, code, count(distinct enc) as n_enc, count(*) as n from code group by 1, 2, 3) select *, cast(row_number() over (order by n_enc desc, code) as int) as place from n")
def code_popularity(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    n = code(spark, d).groupBy("l1", "l2", "code").agg(F.countDistinct("enc").alias("n_enc"), F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_enc"), "code")))


def _place(seed: int, *keys: str) -> str:
    """The random order of the samples, in SQL."""
    return "('0x' || substr(md5('" + str(seed) + "' || " + " || ".join(f"':' || {k}" for k in keys) + "), 1, 12))::bigint"


_SEED = C.seed_of("run-1")


@query(f"with {ENC}, r as (select enc, row_number() over (order by {_place(7, 'enc')}, enc) as i, floor(count(*) over () * 0.9::double) as k from enc) select enc, case when i <= k then 'training' else 'validation' end as split from r")
def train_val_split(spark: SparkSession, d: str) -> DataFrame:
    return C.split(enc(spark, d).select("enc"), "enc", seed=7)


@query(f"with {ENC}, r as (select enc, row_number() over (order by {_place(7, 'enc')}, enc) as i, floor(count(*) over () * 0.9::double) as k from enc) select enc, case when i <= k then 0 else 1 end as split_pos from r")
def split_all(spark: SparkSession, d: str) -> DataFrame:
    """The whole cohort with the training part first."""
    return C.in_split(C.split(enc(spark, d).select("enc"), "enc", seed=7), "all").select("enc", "split_pos")


@query(f"with {ENC}, r as (select enc, row_number() over (order by {_place(7, 'enc')}, enc) as i, floor(count(*) over () * 0.9::double) as k from enc) select enc from r where i <= k order by {_place(_SEED, 'enc')}, enc limit 200")
def sample_of_training(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of the training part."""
    training = C.in_split(C.split(enc(spark, d).select("enc"), "enc", seed=7), "training")
    return C.sample_n(training.select("enc"), "enc", 200, _SEED)


@query(f"select hadm_id from admissions order by {_place(_SEED, 'hadm_id')}, hadm_id limit 100")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return C.sample_n(table(spark, d, "admissions").select("hadm_id"), "hadm_id", 100, _SEED)


@query(f"with {ENC} select enc, lab from enc qualify row_number() over (partition by lab order by {_place(3, 'enc')}, enc) <= 50")
def sample_per_cluster(spark: SparkSession, d: str) -> DataFrame:
    return C.sample_per_group(enc(spark, d).select("enc", "lab"), "lab", "enc", 50, 3)


@query(f"with x as (select vec_id as id, b.boot_id, row_number() over (partition by b.boot_id order by {_place(1, 'b.boot_id', 'vec_id')}, vec_id) as i, cast(floor(count(*) over (partition by b.boot_id) * 0.7::double) as bigint) as k from embeddings cross join (select cast(unnest(range(10)) as int) as boot_id) b) select id, boot_id from x where i <= k")
def bootstrap_membership(spark: SparkSession, d: str) -> DataFrame:
    return C.bootstraps(table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), "id", 10, 0.7, 1)


@query(f"with r as (select hadm_id, row_number() over (order by hadm_id) - 1 as at, count(*) over () as n from admissions), x as (select unnest(range(500)) as draw) select r.hadm_id, x.draw from x join r on r.at = {_place(5, 'x.draw')} % r.n")
def sample_with_replacement(spark: SparkSession, d: str) -> DataFrame:
    return C.sample_with_replacement(table(spark, d, "admissions"), "hadm_id", 500, 5)


@query(f"select {_SEED} as seed, cast(sum({_place(_SEED, 'hadm_id')} % 1000) as bigint) as checksum from admissions")
def seed_of_text(spark: SparkSession, d: str) -> DataFrame:
    """The seed of a run's name and the sum of the places that it gives."""
    a = table(spark, d, "admissions")
    return a.agg(F.lit(_SEED).alias("seed"), F.sum(C.shuffled(_SEED, "hadm_id") % 1000).alias("checksum"))
