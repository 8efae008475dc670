"""Workbooks as a data source: round trips, sheet filters, failed writes."""

import pytest
from pyspark.sql import functions as F

from loomwork.sources import tables, workbook


def test_round_trip_of_several_sheets(spark, tmp_path):
    path = str(tmp_path / "out" / "report.xlsx")
    first = spark.range(3000).select(F.col("id").alias("n"), F.concat(F.lit("a & <b> "), "id").alias("text"), (F.col("id") / 4).alias("score")).repartition(5)
    second = spark.createDataFrame([("Kia", None, [1, 2]), ("é\x01\nline", 7, None)], "company string, n int, list array<int>")
    workbook.write_workbook({"responses": first, "summary": second, "empty": second.limit(0)}, path, {"responses": ["n"]})
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["report.xlsx"]
    got = workbook.cells(spark, path)
    rows = got.where("sheet_name = 'responses'").orderBy("row_index").collect()
    assert rows[0].cells == ["n", "text", "score"] and rows[5].cells == ["4", "a & <b> 4", "1.0"] and len(rows) == 3001
    assert [r.cells for r in got.where("sheet_name = 'summary'").orderBy("row_index").collect()] == [["company", "n", "list"], ["Kia", None, "[1,2]"], ["é\nline", "7", None]]
    assert got.where("sheet_name = 'empty'").count() == 1 and {r.sheet_index for r in got.collect()} == {0, 1, 2}
    same, _ = tables.load_workbook(spark, path)  # the other reader agrees
    assert same.where("sheet_name = 'responses'").count() == 3000
    workbook.write_workbook({"responses": second}, path)
    assert workbook.cells(spark, str(tmp_path / "out")).count() == 3


def test_sheets_and_files_are_left_out_before_reading(spark, tmp_path):
    one = spark.range(3).toDF("n")
    for name in ("a.xlsx", "b.xlsx"):
        workbook.write_workbook({f"s{k}": one for k in range(4)}, str(tmp_path / name))
    assert workbook.cells(spark, str(tmp_path)).rdd.getNumPartitions() == 8
    assert workbook.cells(spark, str(tmp_path), sheets=["s1", "s2"]).rdd.getNumPartitions() == 4
    some = workbook.cells(spark, str(tmp_path), sheets=["s1"], files=["b.xlsx"])
    assert some.rdd.getNumPartitions() == 1 and some.where("row_index > 1").count() == 3 and some.count() == 4
    assert workbook.cells(spark, str(tmp_path), sheets=["none"]).count() == 0


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    bad = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("x"))
    rows = spark.range(10).select(F.lit(0).alias("sheet_index"), F.lit("s").alias("sheet_name"), (F.col("id") + 1).cast("int").alias("row_index"), F.array(F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.lit("x"))).alias("cells"), F.array(F.lit(False)).alias("numbers"))
    spark.dataSource.register(workbook.Workbook)
    with pytest.raises(Exception, match="lost"):
        rows.write.format("workbook").mode("overwrite").save(str(tmp_path / "w.xlsx"))
    with pytest.raises(Exception, match="lost"):
        workbook.write_workbook({"s": bad}, str(tmp_path / "w.xlsx"))
    assert list(tmp_path.iterdir()) == []
    with pytest.raises(ValueError, match="name a sheet"):
        workbook.write_workbook({"a/b": spark.range(1).toDF("n")}, str(tmp_path / "w.xlsx"))


def test_a_report_of_one_model_has_one_run(spark):
    runs = spark.createDataFrame([("a",), ("a",), ("b",)], "run_name string")
    assert workbook.single_run(runs.where("run_name = 'a'")) == "a"
    for bad in (runs, runs.limit(0)):
        with pytest.raises(ValueError, match="one run"):
            workbook.single_run(bad)
