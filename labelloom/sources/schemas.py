"""Declared schemas.  No reader infers: inference costs a pass over the data."""

from __future__ import annotations

from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# The two comment file layouts; every CSV field is read as text.
COMMENT_COLUMNS = ("label", "comment", "author", "subreddit", "score", "ups", "downs",
                   "date", "created_utc", "parent_comment")
TEXT_Y_COLUMNS = ("text", "Y")

COMMENTS_CSV = _strings(*COMMENT_COLUMNS)
COMMENTS_WITH_ID_CSV = _strings("id", *COMMENT_COLUMNS)
TEXT_Y_CSV = _strings(*TEXT_Y_COLUMNS)

LONG, STRING = T.LongType(), T.StringType()

TABLES = {
    "documents": T.StructType().add("doc_id", LONG).add("text", STRING).add("lang", STRING)
    .add("source", STRING).add("n_chars", LONG),
    "labels": T.StructType().add("doc_id", LONG).add("quality", T.IntegerType())
    .add("toxic", T.IntegerType()),
    "conversations": T.StructType().add("conv_id", LONG).add("turn", LONG).add("role", STRING)
    .add("text", STRING),
    "embeddings": T.StructType().add("vec_id", LONG)
    .add("embedding", T.ArrayType(T.FloatType())).add("label", T.IntegerType()),
    "events": T.StructType().add("event_id", LONG).add("ts", T.TimestampNTZType())
    .add("user_id", LONG).add("event_type", STRING).add("value", T.DoubleType())
    .add("props", STRING),
}
