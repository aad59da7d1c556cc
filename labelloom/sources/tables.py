"""CSV and Parquet readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.sources.schemas import CORRUPT, TABLES


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType,
             multi_line: bool = True, keep_corrupt: bool = False) -> DataFrame:
    """CSV with a header, RFC 4180 quoting and a declared schema.

    ``multi_line`` accepts quoted line breaks, but then one file is one task:
    store large inputs as many files, or switch it off where no field holds a
    line break so that files can be split.
    """
    if keep_corrupt:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (spark.read.schema(schema)
            .option("header", True).option("multiLine", multi_line)
            .option("quote", '"').option("escape", '"')
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
            .csv(list(paths) if not isinstance(paths, str) else paths))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The counterpart of ``read_csv``: same quoting, white space kept."""
    (df.write.mode(mode).option("header", True)
     .option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A Parquet table of known schema: file or folder, no footer inference."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}.parquet")


def stream_table(spark: SparkSession, root: str, name: str,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """The same table as a stream.

    File streams take folders or globs, so the last letter is put in brackets;
    this matches a single file as well as a folder of part files.
    """
    reader = spark.readStream.schema(TABLES[name])
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(f"{root}/{name}.parque[t]")


def write_features(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a feature table."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_features(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def union_all(first: DataFrame, *rest: DataFrame, allow_missing: bool = False) -> DataFrame:
    """Bag union by column name, so differing column order cannot mix fields."""
    out = first
    for df in rest:
        out = out.unionByName(df, allowMissingColumns=allow_missing)
    return out


def typed_comments(raw: DataFrame, comment: str = "comment", label: str = "label",
                   keep: Sequence[str] = ()) -> DataFrame:
    """Project a raw table to (keep..., comment, label) with a float label."""
    return raw.select(*keep, F.col(comment).alias("comment"),
                      F.col(label).try_cast("float").alias("label"))


def with_row_id(df: DataFrame, row_id: str = "id") -> DataFrame:
    """Add an id made of the row's content and its occurrence among equal rows.

    The same under any partitioning and on any retry.  Equal rows are counted
    with map-side combining and spread out again, so rows that repeat very
    often need no task of their own.
    """
    marked = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in df.columns])
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return counted.select(
        F.sha2(marked, 256).alias("_digest"), *df.columns,
        F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_occurrence")).select(
        F.concat_ws("-", "_digest", "_occurrence").alias(row_id), *df.columns)


def load_comments(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, comment: str = "comment",
                  label: str = "label", multi_line: bool = True) -> DataFrame:
    """Labelled comments of either file layout: (id, comment, label), without null values."""
    raw = with_row_id(read_csv(spark, paths, schema, multi_line).select(comment, label))
    return typed_comments(raw, comment, label, keep=["id"]).dropna(subset=["comment", "label"])
