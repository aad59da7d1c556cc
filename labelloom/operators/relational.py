"""Projections, filters, joins and counts on comment tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.numeric import label_as_float
from labelloom.functions.text import is_nonempty

# What a reader is shown for a prediction.
POSITIVE_MESSAGE = "It's just SARCASM"
NEGATIVE_MESSAGE = "It's NOT sarcasm"


def project_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the wanted columns; naming them lets the scan skip all others."""
    return df.select(*columns)


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def drop_nulls(df: DataFrame, columns: Sequence[str] = ("comment", "label")) -> DataFrame:
    return df.na.drop(subset=list(columns))


def null_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null counts of all columns in one pass: (column_name, nulls, total)."""
    counts = df.agg(F.count("*").alias("_total"),
                    *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls"))
                      for c in columns])
    return (counts.select("_total", F.explode(pairs).alias("p"))
            .select("p.column_name", "p.nulls", F.col("_total").alias("total")))


def nonempty_tokens(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    return df.filter(is_nonempty(tokens))


def with_label(df: DataFrame, value: float, label: str = "label") -> DataFrame:
    """Rows of one class; labels that are no number never match."""
    return df.filter(label_as_float(label) == F.lit(float(value)))


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and share per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def row_counts(stages: Mapping[str, DataFrame]) -> DataFrame:
    """One (stage, rows) table in place of scattered counts."""
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("stage"), "n_rows")
             for name, df in stages.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def skip_known(df: DataFrame, known: DataFrame, on: str = "id") -> DataFrame:
    """Drop rows whose id is in ``known``.

    First the (usually long) list of known ids is reduced to those that occur
    in ``df``; Spark broadcasts the shorter side when its measured size allows.
    """
    hits = known.select(on).join(df.select(on), on, "left_semi")
    return df.join(hits, on, "left_anti")


def attach_predictions(comments: DataFrame, predictions: DataFrame, on: str = "id") -> DataFrame:
    return comments.join(predictions, on)


def label_message(prediction: Column | str = "prediction", positive: str = POSITIVE_MESSAGE,
                  negative: str = NEGATIVE_MESSAGE) -> Column:
    p = F.col(prediction) if isinstance(prediction, str) else prediction
    return F.when(p == 1.0, F.lit(positive)).otherwise(F.lit(negative))


def misclassified(df: DataFrame, row_id: str = "id", label: str = "label",
                  prediction: str = "prediction", limit: int | None = None) -> DataFrame:
    """All errors, or the first ``limit`` by id as a top-k (no global sort)."""
    errors = df.filter(F.col(prediction) != F.col(label))
    return errors if limit is None else errors.orderBy(row_id).limit(limit)


def exploded(df: DataFrame, keep: Sequence[str | Column], values: str | Column,
             name: str) -> DataFrame:
    """One row per non-null array element.

    For plain ``explode`` Spark adds a filter on the array's size and moves it to
    the scan, where it evaluates the array expression twice more.  The outer
    form has no such filter; dropping its nulls gives the same rows.
    """
    return (df.select(*keep, F.explode_outer(values).alias(name))
            .filter(F.col(name).isNotNull()))
