"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.session import materialize

__all__ = ["materialize", "table", "text_of", "text_digest", "unused", "id_crc"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text as a string; a null text counts as empty."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def text_digest(column: str | Column) -> Column:
    """SHA-256 of the text's UTF-8 bytes, as 32 bytes."""
    return F.unhex(F.sha2(text_of(column), 256))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names made from ``names`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    return [n if n.lower() not in taken else f"{n}_{uuid.uuid4().hex[:8]}" for n in names]


def id_crc(column: str | Column) -> Column:
    """crc32 of the id's decimal text; a null id counts as an empty text."""
    return F.crc32(F.encode(text_of(column), "UTF-8"))
