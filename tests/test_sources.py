import json

import pytest

from cohortloom.sources import readers as R
from cohortloom.sources import sinks as S
from cohortloom.sources.tables import nan_to_null, reading, shared_folder


def test_csv_folder(spark, tmp_path):
    for i in (3, 12):
        (tmp_path / f"patient_{i}.csv").write_text("time,hr,bp\n0,80,\n5,82,120\n")
    df = R.csv_folder(spark, str(tmp_path), "time")
    assert df.count() == 8 and {r.enc for r in df.select("enc").distinct().collect()} == {3, 12}
    assert df.filter("value is null").count() == 2
    x = R.FrameExtractor(df)
    assert x.encounters().count() == 2 and x.events(x.encounters().limit(1)).count() == 4 and x.label("hr") == "hr"
    assert {r.enc for r in R.finished_ids(spark, str(tmp_path), "*.csv").collect()} == {3, 12}
    assert R.file_identity(spark, str(tmp_path)).select("sha").distinct().count() == 1


def test_read_through_and_upsert(spark, tmp_path):
    p = str(tmp_path / "t")
    calls = []

    def make():
        calls.append(1)
        return spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string")

    assert R.read_or_none(spark, p) is None
    assert R.read_through(spark, p, make).count() == 2 and R.read_through(spark, p, make).count() == 2 and len(calls) == 1
    q = str(tmp_path / "u")
    assert R.read_upserted(spark, q) is None
    S.upsert_parquet(make(), q, "id")
    S.upsert_parquet(spark.createDataFrame([(2, "c"), (3, "d")], "id bigint, v string"), q, "id")
    assert {(r.id, r.v) for r in R.read_upserted(spark, q).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert sorted(x.name for x in (tmp_path / "u").iterdir() if not x.name.startswith(".")) == ["_current-2", "v2"]
    (tmp_path / "u" / "v3").mkdir()  # a version that was never marked as whole
    assert R.read_upserted(spark, q).count() == 3


def test_report_files(spark, tmp_path):
    t = spark.createDataFrame([("a_b", 1.23456), ("50%", None)], "name string, x double")
    assert S.latex_table(t, 2) == "\\begin{tabular}{ll}\nname & x \\\\\n\\hline\na\\_b & 1.23 \\\\\n50\\% & -- \\\\\n\\end{tabular}"
    e = spark.createDataFrame([(1, ["x", "y"], 0.5, 0.1, 5.0, 1e-9, True), (2, ["x"], 0.3, 0.3, 1.0, 0.9, False)], "lab int, itemset array<string>, support double, complement_support double, factor double, p_value double, significant boolean")
    S.itemset_tables(e, str(tmp_path), "lab")
    assert spark.read.option("header", True).csv(str(tmp_path / "all")).count() == 2
    assert [x.name for x in (tmp_path / "significant").iterdir() if x.name.startswith("lab")] == ["lab=1"]
    assert spark.read.text(str(tmp_path / "text")).head()[0].startswith("1: (2) [x, y] support 0.500")


def test_jdbc_source_is_a_table_or_a_query(spark):
    for args in ({}, {"table": "a", "query": "select 1"}):
        with pytest.raises(ValueError, match="one of"):
            R.jdbc_table(spark, "jdbc:x", **args)


def test_named_files_are_few(spark, tmp_path):
    with pytest.raises(ValueError, match="more than"):
        S.named_files(spark.range(5).selectExpr("cast(id as string) as name", "'' as text"), str(tmp_path), 4)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x;y", 1.5), (2, None, 2.5)], "enc bigint, v string, n double")
    S.charts(df, str(tmp_path / "c"), 4)
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2
    S.csv_table(df, str(tmp_path / "csv"))
    S.csv_by(df, str(tmp_path / "by"), "enc")
    S.json_rows(df, str(tmp_path / "j"))
    S.text(df, str(tmp_path / "t"), "n")
    assert spark.read.json(str(tmp_path / "j")).count() == 2 and (tmp_path / "by" / "enc=1").exists()
    S.json_document({"b": 1, "a": [1]}, str(tmp_path / "d.json"))
    assert list(json.loads((tmp_path / "d.json").read_text())) == ["a", "b"]


def test_logs_and_tree(spark, tmp_path):
    (tmp_path / "a.log").write_text("epoch 1\nfinished\n")
    assert R.run_logs(spark, str(tmp_path / "*.log")).head().line == "finished"
    (tmp_path / "tree.csv").write_text("# codes\ncode,path\n038,root|001-139|038\n")
    assert R.code_tree(spark, str(tmp_path / "tree.csv")).count() == 3


def test_reading_and_nan(spark):
    rows = [(1.5, "9"), (None, " 12,5 kg"), (None, "1 2"), (float("nan"), "x7"), (None, "-3.25"), (None, "---"), (None, None), (None, ""), (None, "9" * 400), (float("inf"), None), (None, "a" * 100_000 + "4")]
    got = [r.x for r in spark.createDataFrame(rows, "valuenum double, value string").select(reading().alias("x")).collect()]
    assert got == [1.5, 12.5, 12.0, 7.0, -3.25, None, None, None, None, None, 4.0]
    assert nan_to_null(spark.createDataFrame([(float("nan"),)], "a double")).head().a is None


def test_shared_folder_follows_the_session(spark, tmp_path):
    assert shared_folder(spark) != shared_folder(spark)


def test_jdbc_needs_a_driver(spark):
    with pytest.raises(Exception):  # noqa: B017
        R.jdbc_table(spark, "jdbc:none://x", "t").count()
