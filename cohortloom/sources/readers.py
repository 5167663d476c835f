"""Sources: databases, Parquet with read-through, folders of CSV, JSON and logs."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.sources.tables import nan_to_null


class Extractor(Protocol):
    """What a data set must offer; subclasses override the hooks, each from DataFrame to DataFrame."""

    def encounters(self) -> DataFrame: ...

    def events(self, encounters: DataFrame) -> DataFrame: ...

    def static(self, encounters: DataFrame) -> DataFrame: ...

    def label(self, item: str) -> str: ...


class FrameExtractor:
    """Extractor over frames that the user brings: long events (enc, item, t, value) and an optional static
    table; labels are the column names."""

    def __init__(self, events: DataFrame, static: DataFrame | None = None):
        self._events, self._static = nan_to_null(events), static

    def encounters(self) -> DataFrame:
        return self._events.select("enc").distinct()

    def events(self, encounters: DataFrame) -> DataFrame:
        return self.preprocess_events(self._events.join(encounters.select("enc"), "enc", "left_semi"))

    def static(self, encounters: DataFrame) -> DataFrame:
        return self.postprocess_static(encounters if self._static is None else self._static.join(encounters.select("enc"), "enc", "left_semi"))

    def preprocess_events(self, events: DataFrame) -> DataFrame:
        return events

    def postprocess_static(self, static: DataFrame) -> DataFrame:
        return static

    def label(self, item: str) -> str:
        return item


def jdbc_table(spark: SparkSession, url: str, table: str | None = None, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, query: str | None = None, **options) -> DataFrame:
    """A database table, or the result of a query, read in parallel ranges of a key; filters and columns are
    pushed down. Give one of table and query."""
    if (table is None) == (query is None):
        raise ValueError("give one of table and query")
    source = table if query is None else f"({query.strip().rstrip(';')}) t"
    r = spark.read.format("jdbc").option("url", url).option("dbtable", source).options(**options)
    if key:
        r = r.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return nan_to_null(r.load())


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_through(spark: SparkSession, path: str, make) -> DataFrame:
    """A Parquet table, made and written first if it is not there."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_upserted(spark: SparkSession, path: str) -> DataFrame | None:
    """The current version of a table that sinks.upsert_parquet keeps, None where there is none."""
    n = current_version(spark, path)
    return spark.read.parquet(f"{path}/v{n}") if n else None


def current_version(spark: SparkSession, path: str) -> int:
    """Highest version that was marked as whole, 0 if none is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return max([int(n[9:]) for n in names if n.startswith("_current-") and n[9:].isdigit()], default=0)


def read_or_none(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame | None:
    """A table, or None where there is none."""
    return spark.read.format(kind).load(path) if exists(spark, path) else None


def events_of(events: DataFrame, cohort: DataFrame, key: str = "enc") -> DataFrame:
    """Events of a cohort by one scan and a semi-join instead of a query for each encounter."""
    return events.join(cohort.select(key), key, "left_semi")


def file_id(column=None):
    """Digits of the input file's name, as a number."""
    name = F.element_at(F.split(column if column is not None else F.input_file_name(), "/"), -1)
    return F.regexp_extract(name, "[0-9]+", 0).try_cast("bigint")


def csv_folder(spark: SparkSession, folder: str, time: str, share: float = 1.0, seed: int = 1) -> DataFrame:
    """A folder of CSV files, one per encounter, with a time column and numeric columns: long events (enc, t,
    item, value). A share below 1 takes a sample of the files by the hash of their number."""
    wide = spark.read.option("header", True).option("inferSchema", True).csv(folder).withColumn("enc", file_id())
    if share < 1:
        wide = wide.filter(F.pmod(F.xxhash64("enc", F.lit(seed)), F.lit(1_000_003)) < int(share * 1_000_003))
    items = [c for c in wide.columns if c not in (time, "enc")]
    long = wide.select("enc", F.col(time).cast("double").alias("t"), F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(f"`{c}`").cast("double").alias("value")) for c in items])).alias("x"))
    return nan_to_null(long.select("enc", "t", "x.item", "x.value"))


def run_logs(spark: SparkSession, pattern: str) -> DataFrame:
    """Last line of each log file: path, line."""
    whole = spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", r"\s+$", "").alias("value"))
    return whole.select("path", F.element_at(F.split("value", "\n"), -1).alias("line"))


def finished_ids(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Ids in the names of the files of a folder; file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    return files.select(file_id(F.col("path")).alias("enc")).na.drop().distinct()


def file_identity(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file: path, sha."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha"))


def code_tree(spark: SparkSession, path: str) -> DataFrame:
    """Code tree from CSV with columns code and path (names from the root, separated by '|'), comments and
    header lines skipped: closure (code, depth, ancestor)."""
    from cohortloom.operators.taxonomy import closure

    nodes = spark.read.option("header", True).option("comment", "#").csv(path).select("code", F.split("path", r"\|").alias("path"))
    return closure(nodes)


def chronic_codes(spark: SparkSession, path: str) -> DataFrame:
    """Chronic condition table: CSV whose first line is a title and second the header; code and chronic, true
    only for '1'."""
    raw = spark.read.csv(path, quote="'").toDF("code", "name", "chronic", *[f"c{i}" for i in range(len(spark.read.csv(path, quote="'").columns) - 3)])
    rows = raw.select(F.trim("code").alias("code"), (F.trim("chronic") == "1").alias("chronic"))
    return rows.filter(F.col("code").rlike("^[0-9VE]"))
