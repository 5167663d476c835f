"""Static records of encounters. Attributes known only after admission carry the prefix FUTURE_, which keeps
them out of model inputs (see model_inputs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FUTURE = "FUTURE_"


def seconds(col: str | Column) -> Column:
    """Seconds with fraction of a timestamp without zone."""
    return F.unix_micros((F.col(col) if isinstance(col, str) else col).cast("timestamp")) / F.lit(1e6)


def days_between(a: str | Column, b: str | Column) -> Column:
    return (seconds(b) - seconds(a)) / 86_400


def model_inputs(static: DataFrame) -> DataFrame:
    """Leakage barrier: a static table without outcome attributes and without list attributes."""
    return static.select(*[f.name for f in static.schema.fields if FUTURE not in f.name and f.dataType.typeName() != "array"])


def codes_of(codes: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """All values of a repeated field per key as one sorted list."""
    return codes.filter(F.col(value).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(name))


def assemble(admissions: DataFrame, patients: DataFrame, lists: list[DataFrame]) -> DataFrame:
    """Encounters with their patient and with pre-aggregated 1:N fields (each keyed by hadm_id): left joins in
    the order in which keys become known; a missing list is empty."""
    out = admissions.join(patients, "subject_id", "left")
    for part in lists:
        names = [c for c in part.columns if c != "hadm_id"]
        out = out.join(part, "hadm_id", "left")
        for f in part.schema.fields:
            if f.name in names and f.dataType.typeName() == "array":
                out = out.withColumn(f.name, F.coalesce(f.name, F.array().cast(f.dataType)))
    return out


def median_of_medians(events: DataFrame, fields: DataFrame) -> DataFrame:
    """Body size per encounter from repeated readings: mean per moment and item, median over time, median over
    items of a field, conversion, median over fields. events: hadm_id, charttime, itemid, valuenum; fields:
    field_name, itemid. Zero and missing readings do not count. Output: hadm_id, weight_kg, height_cm."""
    used = events.filter("valuenum is not null and valuenum <> 0").join(fields, "itemid")
    per_moment = used.groupBy("hadm_id", "field_name", "itemid", "charttime").agg(F.avg("valuenum").alias("v"))
    per_item = per_moment.groupBy("hadm_id", "field_name", "itemid").agg(F.percentile("v", F.lit(0.5)).alias("v"))
    per_field = per_item.groupBy("hadm_id", "field_name").agg(F.percentile("v", F.lit(0.5)).alias("v"))
    name, v = F.col("field_name"), F.col("v")
    kg = F.when(name == "weight_kg", v).when(name == "weight_oz", v / 35.274).when(name == "weight_lb", v / 2.2046)
    cm = F.when(name == "height_cm", v).when(name == "height_in", v * 2.54)
    return per_field.groupBy("hadm_id").agg(F.percentile(kg, F.lit(0.5)).alias("weight_kg"), F.percentile(cm, F.lit(0.5)).alias("height_cm"))


def stays_summary(icustays: DataFrame) -> DataFrame:
    """Sum of stay durations in days and number of stays, both only over stays with two known ends."""
    known = F.col("intime").isNotNull() & F.col("outtime").isNotNull()
    return icustays.groupBy("hadm_id").agg(
        F.coalesce(F.sum(F.when(known, days_between("intime", "outtime"))), F.lit(0.0)).alias("FUTURE_days_in_care"),
        F.count(F.when(known, 1)).alias("FUTURE_icu_visits"),
    )


def stations(icustays: DataFrame, both: bool = False) -> DataFrame:
    """Distinct stations in order, joined by two underscores. By default only first stations count, as in the
    published results; ``both`` adds the last ones."""
    names = F.collect_set("first_careunit")
    if both:
        names = F.array_union(names, F.collect_set("last_careunit"))
    return icustays.groupBy("hadm_id").agg(F.array_join(F.sort_array(names), "__").alias("FUTURE_icu_stations"))


def age_years(birth: str, at: str, most: float = 89.0) -> Column:
    """Age in years of 365.25 days, capped because higher ages are obscured."""
    return F.least(days_between(birth, at) / 365.25, F.lit(most))


def bmi(weight_kg: str, height_cm: str) -> Column:
    """Weight over squared height, null if either is missing."""
    return F.try_divide(F.col(weight_kg), (F.col(height_cm) / 100) * (F.col(height_cm) / 100))


def survival_flags(death: str, admit: str, discharge: str) -> dict[str, Column]:
    """Outcome flags, true where no death is known. survival_all_time keeps the published definition (no death
    after day 28); survived_ever is plain."""
    dead, a, z = F.col(death), F.col(admit), F.col(discharge)
    month = a + F.expr("interval 28 days")
    return {
        "FUTURE_survival": F.coalesce(~(dead <= month), F.lit(True)),
        "FUTURE_survival_to_discharge": F.coalesce(~(dead <= z), F.lit(True)),
        "FUTURE_survival_all_time": F.coalesce(~(dead > month), F.lit(True)),
        "FUTURE_survived_ever": dead.isNull(),
    }


def ethnicity_group(col: str) -> Column:
    """First letter capital, cut at a slash and at a dash between blanks, two values merged to Other."""
    text = F.concat(F.upper(F.substring(col, 1, 1)), F.lower(F.expr(f"substring({col}, 2)")))
    text = F.element_at(F.split(F.element_at(F.split(text, "/"), 1), " - "), 1)
    return F.when(text == "Multi race ethnicity", "Other").otherwise(text)


def diagnosis_text(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit("No admission diagnosis"))


def canonical_text(col: str) -> Column:
    """Trimmed, double blanks, slashes and backslashes replaced once."""
    c = F.replace(F.trim(F.col(col)), F.lit("  "), F.lit(" "))
    return F.replace(F.replace(c, F.lit("//"), F.lit("/")), F.lit("\\\\"), F.lit("\\"))


def sanitize(col: str) -> Column:
    """Colon, slash and blank become underscores."""
    return F.translate(F.col(col), ":/ ", "___")


def prettify(col: str) -> Column:
    """Underscores become blanks, every word starts with a capital."""
    return F.initcap(F.replace(F.col(col), F.lit("_"), F.lit(" ")))


def cluster_name(col: str) -> Column:
    return F.when(F.col(col) == -1, "Noise").otherwise(F.concat(F.lit("Cluster "), F.col(col).cast("string")))


def category_domain(static: DataFrame, attributes: list[str]) -> DataFrame:
    """Values of categorical attributes with their count and alphabetical index: attr, value, n, idx."""
    pairs = static.select(F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("value")) for a in attributes])).alias("x")).select("x.*")
    from pyspark.sql.window import Window

    counts = pairs.filter("value is not null").groupBy("attr", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("idx", F.dense_rank().over(Window.partitionBy("attr").orderBy("value")) - 1)


def largest_index(domain: DataFrame) -> DataFrame:
    return domain.groupBy("attr").agg(F.max("idx").alias("max_idx"))


def split_by_survival(static: DataFrame, days: str, survived: str) -> DataFrame:
    """Durations of survivors and of the deceased in two columns, null in the other's."""
    return static.withColumn(f"{days}_survivors", F.when(F.col(survived), F.col(days))).withColumn(f"{days}_deceased", F.when(~F.col(survived), F.col(days)))
