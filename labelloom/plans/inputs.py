"""How the given tables stand in for comments, labels and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.numeric import dot, sigmoid
from labelloom.operators.relational import exploded
from labelloom.session import spread
from labelloom.sources.tables import read_table

DIM = 64
# A frozen linear model over the 64 embedding dimensions.
FIXED_WEIGHTS = tuple(((i * 7) % 11 - 5) / 2.0 for i in range(DIM))
FIXED_INTERCEPT = 0.05


def documents(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "documents")


def texts(spark: SparkSession, root: str) -> DataFrame:
    """(id, comment): documents, spread for costly work on their texts."""
    return spread(documents(spark, root).select(
        F.col("doc_id").alias("id"), F.col("text").alias("comment")), "id")


def labelled(spark: SparkSession, root: str, label: str = "quality") -> DataFrame:
    """(id, comment, label): documents that have a label."""
    labels = read_table(spark, root, "labels").select(
        F.col("doc_id").alias("id"), F.col(label).try_cast("float").alias("label"))
    return texts(spark, root).join(labels, "id")


def maybe_labelled(spark: SparkSession, root: str) -> DataFrame:
    """(id, comment, label, lang): all documents; most have a null label."""
    labels = read_table(spark, root, "labels").select("doc_id", F.col("quality").alias("label"))
    return (documents(spark, root).join(labels, "doc_id", "left")
            .select(F.col("doc_id").alias("id"), F.col("text").alias("comment"), "label", "lang"))


def sourced(spark: SparkSession, root: str) -> DataFrame:
    """(id, comment, label): documents labelled by origin; copies conflict."""
    return documents(spark, root).select(
        F.col("doc_id").alias("id"), F.col("text").alias("comment"),
        F.col("source").alias("label"))


def vectors(spark: SparkSession, root: str) -> DataFrame:
    """(id, label, features): embeddings with a binary label."""
    return read_table(spark, root, "embeddings").select(
        F.col("vec_id").alias("id"), (F.col("label") < 5).cast("float").alias("label"),
        F.col("embedding").alias("features"))


def fixed_score(features: Column | str = "features") -> Column:
    return sigmoid(dot(features, FIXED_WEIGHTS) + F.lit(FIXED_INTERCEPT))


def fixed_predictions(spark: SparkSession, root: str) -> DataFrame:
    """(id, label, score, prediction) of the frozen model; scores have ties."""
    scored = vectors(spark, root).withColumn("score", F.round(fixed_score(), 2))
    return scored.select("id", "label", "score",
                         (F.col("score") >= 0.5).cast("double").alias("prediction"))


def requests(docs: DataFrame) -> DataFrame:
    """(request_id, body): a well-formed request for every document, a list of
    comments or a single object (es, fr); and beside them, under negative ids,
    broken copies with a wrong field (fr) or cut off (de)."""
    item = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("comment"))
    as_list = F.to_json(F.struct(F.array(item).alias("textComments")))
    as_object = F.to_json(F.struct(item.alias("textComments")))
    wrong = F.to_json(F.struct(F.array(item).alias("comments")))
    lang, own = F.col("lang"), F.col("doc_id")
    good = F.struct(own.alias("request_id"), F.when(lang.isin("es", "fr"), as_object).otherwise(as_list).alias("body"))
    broken = F.when(lang == "fr", wrong).when(lang == "de", F.rtrim(as_list, F.lit("}")))
    both = F.array(good, F.struct((-own - 1).alias("request_id"), broken.alias("body")))
    return docs.select(F.explode(both).alias("r")).select("r.*").where("body is not null")


def suffix_dictionary(tokens: DataFrame) -> DataFrame:
    """A stand-in lemma table drawn from the corpus: forms in -ing lose it."""
    return (exploded(tokens, [], F.array_distinct("tokens"), "form")
            .filter(F.col("form").rlike("^.{3,}ing$")).distinct()
            .select("form", F.expr("substring(form, 1, length(form) - 3)").alias("lemma")))


_DOT = " + ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) * ({w!r})"
                  for i, w in enumerate(FIXED_WEIGHTS))
FIXED_SCORE_SQL = f"1.0 / (1.0 + exp(-(({_DOT}) + {FIXED_INTERCEPT})))"
FIXED_PREDICTIONS_SQL = f"""
  SELECT id, label, score, CASE WHEN score >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction
  FROM (SELECT vec_id AS id, CASE WHEN label < 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label,
               round({FIXED_SCORE_SQL}, 2) AS score FROM embeddings)"""
LABELLED_SQL = """
  SELECT d.doc_id AS id, d.text AS comment, CAST(l.quality AS DOUBLE) AS label
  FROM documents d JOIN labels l USING (doc_id)"""
