"""Online scoring: requests in, predictions out, as a Structured Streaming job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labelloom.session import materialize
from labelloom.sources.models import ModelPointer
from labelloom.sources.requests import accepted_comments, answered_requests, parse_requests
from labelloom.streaming.keys import KeyTable

# Fixed value: quiet time before a batch of comments is sent off.
DEBOUNCE = "3 seconds"
# Folders that begin with an underscore are not read as part of the output.
KEY_FOLDER, FRESH_FOLDER = "_keys", "_fresh"


def drop_repeats(stream: DataFrame, row_id: str = "id", ts: str = "ts",
                 delay: str = "10 minutes") -> DataFrame:
    """Pass each id once.  State is kept per id and dropped after ``delay``."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([row_id])


def debounce_stream(stream: DataFrame, key: str, ts: str = "ts", gap: str = DEBOUNCE,
                    delay: str = "10 minutes") -> DataFrame:
    """Sessions of one key, closed by ``gap`` of quiet: (key, start, end, n)."""
    return (stream.withWatermark(ts, delay)
            .groupBy(key, F.session_window(ts, gap).alias("s"))
            .agg(F.count("*").alias("n"))
            .select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n"))


def debounce_batch(df: DataFrame, key: str, ts: str = "ts",
                   gap_seconds: float = 3.0) -> DataFrame:
    """The same sessions on a finished table, safe for one very busy key.

    Events are first merged into cells of one gap's length: events of one cell
    always share a session.  Only the cells are sorted per key, and their
    number is bounded by time, not by the number of events.
    """
    gap = F.lit(round(gap_seconds * 1_000_000))
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    cells = (df.filter(F.col(ts).isNotNull()).select(key, us.alias("_us"))
             .groupBy(key, F.floor(F.col("_us") / gap).alias("_cell"))
             .agg(F.min("_us").alias("_lo"), F.max("_us").alias("_hi"), F.count("*").alias("_n")))
    by_time = Window.partitionBy(key).orderBy("_cell")
    opens = F.coalesce(F.col("_lo") - F.lag("_hi").over(by_time) > gap, F.lit(True))
    numbered = (cells.withColumn("_open", opens.cast("int"))
                .withColumn("_session", F.sum("_open").over(by_time)))
    return (numbered.groupBy(key, "_session")
            .agg(F.timestamp_micros(F.min("_lo")).alias("start"),
                 F.timestamp_micros(F.max("_hi") + gap).alias("end"), F.sum("_n").alias("n"))
            .drop("_session"))


def parse_stream(stream: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """Comments of all well-formed requests of a stream."""
    return accepted_comments(parse_requests(stream, body), keep)


def idempotent_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer: a batch that is retried replaces its own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def one_per_id(batch: DataFrame, row_id: str = "id") -> DataFrame:
    """One row per id, on every retry the same: the one with the smallest values."""
    others = [c for c in batch.columns if c != row_id]
    least = batch.groupBy(row_id).agg(F.min(F.struct(*others)).alias("_row"))
    return least.select(row_id, *[F.col(f"_row.{c}").alias(c) for c in others]).select(batch.columns)


def skip_scored_sink(path: str, score: Callable[[DataFrame], DataFrame] | None = None,
                     row_id: str = "id", keys: KeyTable | None = None) -> Callable[[DataFrame, int], None]:
    """Like ``idempotent_sink``, but ids of an earlier batch are left out before ``score`` runs.

    They are looked up in ``keys`` (by itself a table in the output's folder that
    readers of the output don't see), where a batch reads the buckets of its own
    ids only.  The ids go there after the output, so a batch that is retried in
    between writes both again.
    """
    table = keys or KeyTable(f"{path}/{KEY_FOLDER}", row_id)

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = materialize(table.unseen(one_per_id(batch, row_id), batch_id), "fresh",
                            f"{path}/{FRESH_FOLDER}")
        out = score(fresh) if score else fresh
        out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        table.add(fresh, batch_id)
    return write


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
          interval: str | None = None) -> StreamingQuery:
    """Run on a fixed interval, or over what is there now if none is given."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    writer = (writer.trigger(processingTime=interval) if interval
              else writer.trigger(availableNow=True))
    return writer.start()


def score_requests(stream: DataFrame, model: PipelineModel | ModelPointer, out: str, quarantine: str,
                   checkpoint: str, interval: str | None = DEBOUNCE, body: str = "body",
                   ts: str | None = None, delay: str = "10 minutes") -> StreamingQuery:
    """Score every comment of every request, each id once.

    Predictions (id, prediction) go to ``out`` and unusable requests with their
    reason to ``quarantine``.  With an event time ``ts``, keyed state drops ids
    that come again within ``delay`` before they reach a batch; in any case the
    table of scored ids keeps those of earlier batches out, however old.

    A model that is given by a pointer is looked up between batches, and its
    version is written with each prediction.
    """
    rejected_sink = idempotent_sink(quarantine)
    scored_sinks: dict[str, Callable[[DataFrame, int], None]] = {}

    def scored_sink() -> Callable[[DataFrame, int], None]:
        if isinstance(model, PipelineModel):
            return scored_sinks.setdefault("", skip_scored_sink(
                out, lambda fresh: model.transform(fresh).select("id", "prediction")))
        version, current = model.current()
        return scored_sinks.setdefault(version, skip_scored_sink(
            out, lambda fresh: current.transform(fresh).select("id", "prediction", F.lit(version).alias("model_version"))))

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            scored_sink()(rows.where("reject_reason is null").select("id", "comment"), batch_id)
            rejected_sink(rows.where("reject_reason is not null").drop("id", "comment"), batch_id)
        finally:
            rows.unpersist()

    return start(_answered(stream, body, ts, delay), sink, checkpoint, interval)


def _answered(stream: DataFrame, body: str, ts: str | None, delay: str) -> DataFrame:
    """Rows of comments and of unusable requests; with an event time, none that comes again within ``delay``."""
    if not ts:
        return answered_requests(stream, body)
    rows = answered_requests(stream.withWatermark(ts, delay), body)
    return rows.withColumn("_refused", F.sha2(body, 256)).dropDuplicatesWithinWatermark(["id", "_refused"]).drop("_refused", ts)
