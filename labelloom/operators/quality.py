"""Counts that come with the job that runs anyway, on batches and on streams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

REPORT = "stage string, metric string, value bigint"


def _metrics(columns: Sequence[str], classes: Mapping[str, Sequence]) -> list:
    """Rows, nulls of columns, and rows of each given value of the class columns."""
    return [F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"nulls:{c}") for c in columns],
            *[F.count_if(F.col(c) == F.lit(v)).alias(f"{c}={v}") for c, values in classes.items() for v in values]]


class QualityReport:
    """Watches stages of a job; ``table`` has the counts once the job has run.

    No stage is read or computed again for its counts.
    """

    def __init__(self):
        self._seen: dict[str, Observation] = {}

    def watch(self, stage: str, df: DataFrame, columns: Sequence[str] = (), classes: Mapping[str, Sequence] | None = None) -> DataFrame:
        """``df``, whose rows are counted as they pass."""
        if stage in self._seen:
            raise ValueError(f"stage {stage!r} is watched already")
        self._seen[stage] = Observation(stage)
        return df.observe(self._seen[stage], *_metrics(columns, classes or {}))

    def table(self, spark: SparkSession) -> DataFrame:
        """(stage, metric, value) of all stages; waits for the job if it is still running."""
        rows = [(stage, m, int(v)) for stage, seen in self._seen.items() for m, v in seen.get.items()]
        return spark.createDataFrame(rows, REPORT)


def watch_stream(stage: str, stream: DataFrame, columns: Sequence[str] = (), classes: Mapping[str, Sequence] | None = None) -> DataFrame:
    """The same on a stream: the counts of each batch are in the query's progress."""
    return stream.observe(stage, *_metrics(columns, classes or {}))


def stream_table(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """(stage, metric, value) summed over the batches that the query still remembers."""
    sums: dict[tuple[str, str], int] = {}
    for progress in query.recentProgress:
        for stage, row in progress.observedMetrics.items():
            for metric, value in row.asDict().items():
                sums[stage, metric] = sums.get((stage, metric), 0) + int(value)
    return spark.createDataFrame([(s, m, v) for (s, m), v in sums.items()], REPORT)
