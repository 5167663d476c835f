"""Reading the input tables, and the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing has one form, NULL: every NaN of a double or float column becomes NULL."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats}) if floats else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table (file or folder) of a data directory, lazily; times are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return nan_to_null(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def epoch_s(col: Column | str) -> Column:
    """Whole epoch seconds of a timestamp without zone, read as UTC."""
    col = F.col(col) if isinstance(col, str) else col
    return F.unix_seconds(col.cast("timestamp"))


#: Blanks of any kind that may stand in a reading.
BLANKS = "[\\s\\u0085\\u00A0\\u1680\\u2000-\\u200B\\u202F\\u205F\\u3000\\uFEFF]"


def reading(valuenum: Column | str = "valuenum", value: Column | str = "value") -> Column:
    """The number of a row: valuenum or, where that is null, the number written in value.

    Decimal commas are allowed, a unit may stand beside the number, blanks do not matter; a text without
    digits gives NULL. Infinite numbers give NULL.
    """
    valuenum = F.col(valuenum) if isinstance(valuenum, str) else valuenum
    value = F.col(value) if isinstance(value, str) else value
    text = F.regexp_extract(F.regexp_replace(value, BLANKS, ""), "-?[0-9]+(?:[.,][0-9]+)?", 0)
    given = F.when(~F.isnan(valuenum), valuenum)
    number = F.coalesce(given, F.replace(text, F.lit(","), F.lit(".")).try_cast("double"))
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def shared_folder(spark: SparkSession) -> str:
    """A new folder for tables that cut the lineage, inside the folder that spark.checkpoint.dir names.

    Only where that setting is absent and the master is local (tests on one machine) a temporary folder is
    used instead; on a cluster its absence is an error, as executors would not find each other's files. The
    folder goes when the session's JVM ends; tables that are to stay belong into a folder that the caller names.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cohortloom-")
        spark.sparkContext.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/cohortloom-{os.getpid()}-{uuid.uuid4().hex[:12]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder
