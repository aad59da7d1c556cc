"""Scoring requests in, scoring responses out, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.operators.relational import exploded

# Field names of the request and the response.
REQUEST_FIELD = "textComments"
ID_FIELD = "id"
COMMENT_FIELD = "comment"
PREDICTION_FIELD = "prediction"

NOT_JSON = "not_json"
MISSING_FIELD = "missing_textComments"
BAD_ITEMS = "bad_items"
NO_COMMENT = "item_without_comment"

_ITEM = f"struct<{ID_FIELD}:string,{COMMENT_FIELD}:string>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it is used.

    Spark moves filters on derived columns down to the scan and repeats the
    whole expression there for every mention; a lambda variable is one mention.
    """
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _parsed(body: Column) -> Column:
    """struct(items, reason): what can be scored, and why not all of the body can."""
    path = f"$.{REQUEST_FIELD}"

    def verdict(odd: Column, items: Column) -> Column:
        broken = F.exists(items, lambda i: i.isNull() | i[ID_FIELD].isNull())
        has_field = F.try_variant_get(odd, path, "variant").isNotNull()
        reason = (F.when(items.isNotNull() & ~broken, F.lit(None))
                  .when(items.isNotNull(), BAD_ITEMS)
                  .when(odd.isNull(), NOT_JSON)
                  .when(~has_field, MISSING_FIELD)
                  .otherwise(BAD_ITEMS))
        whole = F.filter(items, lambda i: i[COMMENT_FIELD].isNotNull())
        partial = F.when(F.size(whole) < F.size(items), NO_COMMENT)
        return _let(reason, lambda r: F.struct(F.when(r.isNull(), whole).alias("items"),
                                               F.coalesce(r, partial).alias("reason")))

    def second_look(usual: Column, odd: Column) -> Column:
        single = F.try_variant_get(odd, path, _ITEM)
        items = F.coalesce(usual, _let(single, lambda s: F.when(s.isNotNull(), F.array(s))))
        return _let(items, lambda i: verdict(odd, i))

    usual_form = F.from_json(body, f"{REQUEST_FIELD} array<{_ITEM}>")[REQUEST_FIELD]
    return _let(usual_form, lambda usual: _let(
        F.when(usual.isNull(), F.try_parse_json(body)), lambda odd: second_look(usual, odd)))


def parse_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """Add ``items`` (array of id and comment) and ``reject_reason`` to each body.

    A single object in place of a list counts as a list of one; every item must
    be an object with an id.  An unusable body has a reason and no items.  An item
    without a comment is left out of the items and gives the body a reason, while
    its sisters are kept.  The usual form is read in one pass; only other bodies
    are looked at again.
    """
    return (df.withColumn("_parsed", _parsed(F.col(body)))
            .withColumn("items", F.col("_parsed.items"))
            .withColumn("reject_reason", F.col("_parsed.reason")).drop("_parsed"))


def accepted_comments(parsed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row (id, comment) per comment of every accepted request.

    Rejected requests have null items and so give no rows.
    """
    return (exploded(parsed, keep, "items", "item")
            .select(*keep, F.col(f"item.{ID_FIELD}"), F.col(f"item.{COMMENT_FIELD}")))


def rejected_requests(parsed: DataFrame) -> DataFrame:
    """The quarantine: bodies that can't be used, or not all of them, with the reason."""
    return parsed.filter(F.col("reject_reason").isNotNull()).drop("items")


def answered_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """A row for each comment (id, comment), and one for each body that can't be used, or not all of it.

    The latter have a ``reject_reason`` and the body, comments have neither;
    other columns are kept.  Bodies are parsed once for both.
    """
    def entry(item_id: Column, comment: Column, reason: Column) -> Column:
        return F.struct(item_id.cast("string").alias(ID_FIELD), comment.cast("string").alias(COMMENT_FIELD),
                        reason.cast("string").alias("reject_reason"))

    none = F.lit(None)
    empty = F.array().cast(f"array<struct<{ID_FIELD}:string,{COMMENT_FIELD}:string,reject_reason:string>>")

    def entries(parsed: Column) -> Column:
        comments = F.transform(parsed["items"], lambda i: entry(i[ID_FIELD], i[COMMENT_FIELD], none))
        refusal = F.when(parsed["reason"].isNotNull(), F.array(entry(none, none, parsed["reason"])))
        return F.concat(F.coalesce(comments, empty), F.coalesce(refusal, empty))

    rows = exploded(df, df.columns, _let(_parsed(F.col(body)), entries), "entry")
    return rows.select(*[c for c in df.columns if c != body], "entry.*",
                       F.when(F.col("entry.reject_reason").isNotNull(), F.col(body)).alias(body))


def response_json(prediction: Column | str = "prediction", row_id: Column | str = "id") -> Column:
    """One response record as JSON text."""
    p = F.col(prediction) if isinstance(prediction, str) else prediction
    i = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.to_json(F.struct(p.cast("double").alias(PREDICTION_FIELD), i.alias(ID_FIELD)))
