"""Queries on streams, run over what is there now and read back."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.operators.classify import make_classifier
from labelloom.operators.feature_sets import hashed_tfidf
from labelloom.plans.inputs import documents, labelled, requests
from labelloom.plans.prepare import fit_once
from labelloom.plans.registry import query
from labelloom.session import materialize, scratch_dir, spread
from labelloom.sources.models import load_pipeline, save_model
from labelloom.sources.requests import accepted_comments, parse_requests
from labelloom.sources.tables import read_table, stream_table
from labelloom.streaming import score as st

PREDICTIONS = "id string, prediction double, batch_id bigint"


def _drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append everything the stream holds now to a Parquet folder."""
    (stream.writeStream.format("parquet").option("path", path)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True)
     .start().awaitTermination())


def _timed(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_source", """
  SELECT doc_id AS request_id, CAST(doc_id AS VARCHAR) AS id, text AS comment FROM documents""")
def stream_source(spark: SparkSession, root: str) -> DataFrame:
    out = scratch_dir(spark, "stream-source")
    bodies = requests(stream_table(spark, root, "documents"))
    comments = st.parse_stream(bodies, keep=("request_id",))
    _drain(comments, f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema(comments.schema).parquet(f"{out}/rows")


@query("stream_dedupe", "SELECT DISTINCT user_id AS id FROM events")
def stream_dedupe(spark: SparkSession, root: str) -> DataFrame:
    # The delay spans the whole table, so that each id passes once.
    out = scratch_dir(spark, "stream-dedupe")
    events = _timed(stream_table(spark, root, "events")).select(F.col("user_id").alias("id"), "ts")
    _drain(st.drop_repeats(events, delay="60 days"), f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema(events.schema).parquet(f"{out}/rows").select("id")


_GAP_US = 6 * 3600 * 1_000_000


@query("debounce_sessions", f"""
  WITH e AS (SELECT user_id, epoch_us(ts) AS us FROM events),
  o AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY us), {_GAP_US} + 1)
               > {_GAP_US} AS opens FROM e),
  s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY us) AS session FROM o)
  SELECT user_id, min(us) AS start_us, max(us) + {_GAP_US} AS end_us, count(*) AS n
  FROM s GROUP BY user_id, session""")
def debounce_sessions(spark: SparkSession, root: str) -> DataFrame:
    sessions = st.debounce_batch(_timed(read_table(spark, root, "events")), "user_id",
                                 gap_seconds=_GAP_US / 1_000_000)
    return sessions.select("user_id", F.unix_micros("start").alias("start_us"),
                           F.unix_micros("end").alias("end_us"), "n")


@query("stream_skip_scored", """
  SELECT doc_id AS id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 0::BIGINT ELSE 1::BIGINT END AS batch_id
  FROM documents""")
def stream_skip_scored(spark: SparkSession, root: str) -> DataFrame:
    # The first batch scores the labelled documents; the second brings all of
    # them and must write only the others.
    base = scratch_dir(spark, "skip-scored")
    inbox, out = f"{base}/inbox", f"{base}/out"
    for ids in (read_table(spark, root, "labels"), documents(spark, root)):
        ids.select(F.col("doc_id").alias("id")).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema("id bigint").parquet(inbox)
        st.start(stream, st.skip_scored_sink(out), f"{base}/checkpoint").awaitTermination()
    return spark.read.schema("id bigint, batch_id bigint").parquet(out)


@query("stream_late_data", "SELECT event_id AS id FROM events")
def stream_late_data(spark: SparkSession, root: str) -> DataFrame:
    # A second delivery repeats every event under a new id, a year too late.
    base = scratch_dir(spark, "late-data")
    inbox, out = f"{base}/inbox", f"{base}/rows"
    events = _timed(read_table(spark, root, "events")).select(F.col("event_id").alias("id"), "ts")
    late = events.select((-F.col("id") - 1).alias("id"), (F.col("ts") - F.expr("INTERVAL 365 DAYS"))
                         .alias("ts"))
    for delivery in (events, late):
        delivery.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(events.schema).parquet(inbox)
        _drain(st.drop_repeats(stream, delay="60 days"), out, f"{base}/checkpoint")
    return spark.read.schema(events.schema).parquet(out).select("id")


@query("stream_score", """
  SELECT CAST(doc_id AS VARCHAR) AS id, TRUE AS as_in_batch FROM documents""")
def stream_score(spark: SparkSession, root: str) -> DataFrame:
    # Whether a comment gets the prediction it would get in a batch job.
    base = scratch_dir(spark, "stream-score")
    train = materialize(labelled(spark, root), "corpus")
    stages = [*hashed_tfidf().getStages(), make_classifier("logistic")]
    fitted = fit_once(Pipeline(stages=stages), train, keep=("id", "label"))
    model = load_pipeline(save_model(fitted, f"{base}/model"))
    stream = requests(stream_table(spark, root, "documents"))
    st.score_requests(stream, model, f"{base}/out", f"{base}/rejected", f"{base}/checkpoint",
                      interval=None).awaitTermination()
    online = spark.read.schema(PREDICTIONS).parquet(f"{base}/out")
    batch = model.transform(accepted_comments(parse_requests(requests(spread(documents(spark, root), "doc_id")))))
    pairs = online.join(batch.select("id", F.col("prediction").alias("expected")), "id", "full")
    return pairs.select("id", F.col("prediction").eqNullSafe(F.col("expected"))
                        .alias("as_in_batch"))
