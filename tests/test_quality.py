"""Counts that come with the job: right, on batches and streams, and without another scan."""

from __future__ import annotations

import pytest

from labelloom.operators import quality


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("q") / "rows")
    data = [(1, "a", 0.0), (2, None, 1.0), (3, "c", None), (4, "d", 1.0), (5, None, None)]
    spark.createDataFrame(data, "id int, comment string, label double").repartition(2).write.parquet(path)
    return path


def watched(report, df):
    seen = report.watch("loaded", df, ["comment", "label"], {"label": [0, 1]})
    return report.watch("kept", seen.na.drop(), ["comment"], {"label": [1]})


WANT = {("loaded", "rows"): 5, ("loaded", "nulls:comment"): 2, ("loaded", "nulls:label"): 2, ("loaded", "label=0"): 1,
        ("loaded", "label=1"): 2, ("kept", "rows"): 2, ("kept", "nulls:comment"): 0, ("kept", "label=1"): 1}


def test_report_of_a_batch(spark, rows, tmp_path):
    report = quality.QualityReport()
    watched(report, spark.read.parquet(rows)).write.parquet(str(tmp_path / "out"))
    assert {(r.stage, r.metric): r.value for r in report.table(spark).collect()} == WANT
    with pytest.raises(ValueError):
        report.watch("kept", spark.range(1))


def test_one_scan_for_all_counts(spark, rows, capsys):
    watched(quality.QualityReport(), spark.read.parquet(rows)).explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan") == 1 and plan.count("CollectMetrics") == 2 and "Aggregate" not in plan


def test_report_of_a_stream(spark, rows, tmp_path):
    stream = spark.readStream.schema("id int, comment string, label double").option("maxFilesPerTrigger", 1).parquet(rows)
    seen = quality.watch_stream("loaded", stream, ["comment"], {"label": [0, 1]})
    query = (seen.writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    query.awaitTermination()
    got = {(r.stage, r.metric): r.value for r in quality.stream_table(spark, query).collect()}
    assert got == {k: v for k, v in WANT.items() if k[0] == "loaded" and k[1] != "nulls:label"}
