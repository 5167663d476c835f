"""Sinks: partitioned Parquet, JSON, CSV and text."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def charts(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Charts by hash bucket of the encounter: few large files, not one for each encounter."""
    bucket = F.pmod(F.xxhash64("enc"), F.lit(buckets)).cast("int")
    df.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("enc").write.mode("overwrite").partitionBy("bucket").parquet(path)


def json_document(value, path: str) -> None:
    """A small document, pretty, with sorted keys."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=4, sort_keys=True)


def json_rows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv_table(df: DataFrame, path: str, one_file: bool = True, quote_text: bool = True) -> None:
    """A report table as CSV, text quoted; one file, as reports are small."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).option("quoteAll", quote_text).csv(path)


def csv_by(df: DataFrame, path: str, by: str) -> None:
    """One folder of CSV for each value of a column; values without rows get none."""
    df.repartition(by).write.mode("overwrite").option("header", True).partitionBy(by).csv(path)


def text(df: DataFrame, path: str, column: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def upsert_parquet(new: DataFrame, path: str, key: str) -> None:
    """Upsert of a keyed Parquet table, read by readers.read_upserted. A new version is written beside the old
    one and marked when it is whole; only then the old one goes. A crash leaves one or the other."""
    from cohortloom.operators.features import upsert
    from cohortloom.sources.readers import current_version

    spark = new.sparkSession
    n = current_version(spark, path)
    rows = upsert(new, spark.read.parquet(f"{path}/v{n}"), key) if n else new
    rows.write.mode("overwrite").parquet(f"{path}/v{n + 1}")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.create(fs_path(f"{path}/_current-{n + 1}"), True).close()
    if n:
        fs.delete(fs_path(f"{path}/_current-{n}"), False)
        fs.delete(fs_path(f"{path}/v{n}"), True)


def named_files(texts: DataFrame, folder: str, most: int = 1_000) -> None:
    """One file for each row (name, text) of a small table; more than ``most`` rows are refused."""
    rows = texts.select("name", "text").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} files: write a table instead")
    spark = texts.sparkSession
    for name, body in rows:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(body or "", "utf-8"))
        out.close()


def latex_table(rows: DataFrame, digits: int = 3, most: int = 1_000) -> str:
    """A small report table as a LaTeX tabular: numbers with a number of digits, missing cells as dashes."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows: this is a table for a page")
    cell = lambda v: "--" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("_", "\\_").replace("%", "\\%").replace("&", "\\&")
    lines = [" & ".join(map(cell, r)) + " \\\\" for r in [rows.columns, *found]]
    return "\n".join(["\\begin{tabular}{" + "l" * len(rows.columns) + "}", lines[0], "\\hline", *lines[1:], "\\end{tabular}"])


def itemset_tables(enriched: DataFrame, folder: str, label: str) -> None:
    """The tables of an itemset analysis: all sets, the significant ones by cluster (clusters without any get
    no file), and the listing as text."""
    from cohortloom.operators.itemsets import itemset_text, listing

    flat = enriched.withColumn("itemset", itemset_text())
    csv_table(flat, f"{folder}/all")
    csv_by(flat.filter("significant"), f"{folder}/significant", label)
    shown = listing(enriched, label).withColumn("line", F.format_string("%s: %s support %.3f against %.3f (p = %.2e)", F.col(label).cast("string"), itemset_text(), "support", "complement_support", "p_value"))
    text(shown.orderBy(label, "place"), f"{folder}/text", "line")


def support_statistics(support: DataFrame, path: str) -> None:
    """Support of each signal, largest first, as one JSON file."""
    support.orderBy(F.desc("support"), "item").coalesce(1).write.mode("overwrite").json(path)


def projection_json(points: DataFrame, path: str) -> None:
    """Projected points (id, features, label) as JSON rows with coordinates x, y, z."""
    points.select("id", "label", *[F.col("features")[i].alias(c) for i, c in enumerate("xyz")]).write.mode("overwrite").json(path)
