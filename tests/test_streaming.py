"""Streams against the batch results on the same rows."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from labelloom.operators.classify import make_classifier
from labelloom.operators.feature_sets import hashed_tfidf
from labelloom.sources.models import ModelPointer, save_model
from labelloom.sources.tables import read_table, stream_table
from labelloom.streaming import score as st
from labelloom.streaming.keys import KeyTable

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def drain(stream, path, checkpoint):
    (stream.writeStream.format("parquet").option("path", str(path))
     .option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
     .awaitTermination())


def test_file_and_folder_streams(spark, sf, tmp_path):
    drain(stream_table(spark, sf, "labels"), tmp_path / "a", tmp_path / "ca")
    read_table(spark, sf, "labels").repartition(3).write.parquet(str(tmp_path / "labels.parquet"))
    drain(stream_table(spark, str(tmp_path), "labels", 1), tmp_path / "b", tmp_path / "cb")
    want = read_table(spark, sf, "labels").count()
    assert spark.read.parquet(str(tmp_path / "a")).count() == want
    assert spark.read.parquet(str(tmp_path / "b")).count() == want


@pytest.fixture(scope="module")
def clicks(spark):
    rows = [("u", at(0)), ("u", at(2)), ("u", at(5)), ("u", at(5.5)), ("u", at(20)),
            ("v", at(1)), ("v", at(4.5)), ("w", at(7)), ("w", at(7))]
    return spark.createDataFrame(rows, "user string, ts timestamp")


def test_debounce_batch_equals_session_window(clicks):
    want = clicks.groupBy("user", F.session_window("ts", "3 seconds").alias("s")).agg(
        F.count("*").alias("n")).select("user", "s.start", "s.end", "n")
    got = st.debounce_batch(clicks, "user")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_debounce_batch_on_events(spark, sf):
    events = read_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    want = events.groupBy("user_id", F.session_window("ts", "12 hours").alias("s")).agg(
        F.count("*").alias("n")).select("user_id", "s.start", "s.end", "n")
    got = st.debounce_batch(events, "user_id", gap_seconds=12 * 3600)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_debounce_stream_closes_sessions(spark, clicks, tmp_path):
    clicks.write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("z", at(10_000))], clicks.schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(clicks.schema).parquet(str(tmp_path / "in"))
    drain(st.debounce_stream(stream, "user", delay="1 minute"), tmp_path / "out", tmp_path / "c")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, st.debounce_batch(clicks, "user").collect()))


def test_repeats_and_late_rows(spark, tmp_path):
    schema = "id string, ts timestamp"
    for batch in ([("a", at(0)), ("a", at(1)), ("b", at(2))],
                  [("a", at(3)), ("c", at(4)), ("late", at(-7200))]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        drain(st.drop_repeats(stream), tmp_path / "out", tmp_path / "c")
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_sink_retry_replaces_its_batch(spark, tmp_path):
    sink = st.skip_scored_sink(str(tmp_path / "out"))
    first, second = spark.range(0, 5), spark.range(3, 8)
    sink(first, 0)
    sink(second, 1)
    sink(second, 1)  # a retry after a failure
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(8))


def test_scoring_job(spark, tmp_path):
    train = spark.createDataFrame([(i, "yes sure" if i % 2 else "no thanks", float(i % 2)) for i in range(20)],
                                  "id long, comment string, label double")
    stages = [*hashed_tfidf(num_features=64).getStages(), make_classifier("logistic", regParam=0.0)]
    model = Pipeline(stages=stages).fit(train)
    inbox = tmp_path / "in"
    inbox.mkdir()
    bodies = [
        json.dumps({"textComments": [{"id": "a", "comment": "YES!"}, {"id": "b", "comment": "thanks"}]}),
        json.dumps({"textComments": [{"id": "a", "comment": "yes"}, {"id": "c", "comment": "sure"}]}),
        "{oops",
    ]
    for i, body in enumerate(bodies):
        (inbox / f"{i}.txt").write_text(body)
        stream = spark.readStream.schema("value string").option("wholetext", True).text(str(inbox))
        st.score_requests(stream, model, str(tmp_path / "out"), str(tmp_path / "bad"),
                          str(tmp_path / "c"), interval=None, body="value").awaitTermination()
    got = {r.id: r.prediction for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": 1.0, "b": 0.0, "c": 1.0}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert [r.reject_reason for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["not_json"]


def test_a_batch_reads_its_own_buckets(spark, tmp_path):
    """However much the table holds, only the folders of the batch's ids are listed and read."""
    table = KeyTable(str(tmp_path / "keys"), buckets=64)
    for n in range(3):
        table.add(spark.range(1000 * n, 1000 * n + 1000), n)
    batch = spark.createDataFrame([(5,), (1500,), (-1,)], "id long")
    mine = {r[0] for r in batch.select(table.bucket()).collect()}
    files = table.known(batch, 3).inputFiles()
    assert files and {int(f.split("key_bucket=")[1].split("/")[0]) for f in files} <= mine
    assert [r.id for r in table.unseen(batch, 3).collect()] == [-1]
    assert sorted(r.id for r in table.unseen(batch, 1).collect()) == [-1, 1500]  # as a retry of batch 1 sees it


def test_keys_are_carried_to_the_next_epoch(spark, tmp_path):
    table = KeyTable(str(tmp_path / "keys"), buckets=4, roll=3)
    for n in range(8):
        batch = spark.range(10 * n, 10 * n + 15)
        fresh = table.unseen(batch, n)
        assert fresh.count() == (15 if n == 0 else 10)
        table.add(fresh, n)
        if n == 3:  # the first batch of an epoch, once more
            assert table.unseen(batch, n).count() == 10
    files = table.known(spark.range(85), 8).inputFiles()
    assert all("epoch=2" in f for f in files) and len({f for f in files if "key_batch=-1" in f}) <= 4


def _post(spark, inbox, rows):
    """Requests with the time of their arrival: [(seconds, ids)]."""
    bodies = [(json.dumps({"textComments": [{"id": i, "comment": f"yes {i}"} for i in ids]}), at(s)) for s, ids in rows]
    spark.createDataFrame(bodies, "body string, ts timestamp").write.mode("append").parquet(str(inbox))
    return spark.readStream.schema("body string, ts timestamp").parquet(str(inbox))


@pytest.fixture(scope="module")
def yes_models(spark):
    """Two models that disagree on everything."""
    train = spark.createDataFrame([(i, "yes" if i % 2 else "no", float(i % 2)) for i in range(20)],
                                  "id long, comment string, label double")
    stages = [*hashed_tfidf(num_features=64).getStages(), make_classifier("logistic", regParam=0.0)]
    return [Pipeline(stages=stages).fit(train.withColumn("label", F.abs(F.col("label") - flip))) for flip in (0, 1)]


def test_repeats_across_requests_and_restarts(spark, tmp_path, yes_models):
    """Repeats in a request, in the next, after a restart and long after are scored once."""
    for rows in ([(0, ["a", "b", "a"]), (1, ["b", "c"])], [(2, ["c", "d"])], [(86_400, ["a", "d", "e"])]):
        stream = _post(spark, tmp_path / "in", rows)
        st.score_requests(stream, yes_models[0], str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "c"),
                          interval=None, ts="ts").awaitTermination()
    got = sorted((r.id, r.batch_id) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [i for i, _ in got] == ["a", "b", "c", "d", "e"]
    assert spark.read.schema("id string").parquet(str(tmp_path / "out")).count() == 5


def test_a_new_model_takes_over_without_a_restart(spark, tmp_path, yes_models):
    pointer = ModelPointer(spark, str(tmp_path / "in_use"))
    with pytest.raises(LookupError):
        pointer.current()
    for n, model in enumerate(yes_models):
        save_model(model, str(tmp_path / f"model{n}"))
    pointer.publish(str(tmp_path / "model0"))
    query = st.score_requests(_post(spark, tmp_path / "in", [(0, ["a"])]), pointer, str(tmp_path / "out"),
                              str(tmp_path / "bad"), str(tmp_path / "c"), interval="100 milliseconds")
    query.processAllAvailable()
    pointer.publish(str(tmp_path / "model1"))
    _post(spark, tmp_path / "in", [(1, ["b"])])
    query.processAllAvailable()
    query.stop()
    got = {r.id: (r.prediction, r.model_version) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": (1.0, "1"), "b": (0.0, "2")}


def test_buckets_are_written_side_by_side(spark, tmp_path):
    """By several tasks, and each bucket by one of them."""
    table = KeyTable(str(tmp_path / "keys"))
    table.add(spark.range(2000).withColumn("id", F.col("id").cast("string")), 0)
    files = [f for f in (tmp_path / "keys").rglob("part-*.parquet")]
    assert len(files) == len({f.parent for f in files}) == 256
    assert len({f.name.split("-")[1] for f in files}) > 1
