"""Queries on sources, projections, filters, joins, counts and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions import text as tx
from labelloom.functions.hashing import row_digest
from labelloom.functions.numeric import (array_to_vector, element_columns, floats, label_as_float,
                                         vector_to_array)
from labelloom.operators import curate, quality, relational as rel, sampling, tokens as tok, weights
from labelloom.plans import sqltext as q
from labelloom.plans.inputs import (DIM, LABELLED_SQL, documents, labelled, maybe_labelled,
                                    requests, sourced, suffix_dictionary, texts, vectors)
from labelloom.plans.registry import query
from labelloom.session import scratch_dir, spread
from labelloom.sources import requests as rq
from labelloom.sources import tables as tb
from labelloom.sources.schemas import COMMENT_COLUMNS, COMMENTS_CSV, TEXT_Y_CSV, _strings
from labelloom.sources.tables import read_table

# --- sources and sinks ------------------------------------------------------


@query("csv_scan", "SELECT doc_id, text, lang FROM documents")
def csv_scan(spark: SparkSession, root: str) -> DataFrame:
    path = scratch_dir(spark, "csv")
    tb.write_csv(documents(spark, root).select("doc_id", "text", "lang"), path)
    back = tb.read_csv(spark, path, _strings("doc_id", "text", "lang"))
    return back.withColumn("doc_id", F.col("doc_id").try_cast("bigint"))


@query("union_sources", """
  SELECT text AS comment, CASE role WHEN 'user' THEN '1' ELSE '0' END AS label
  FROM conversations""")
def union_sources(spark: SparkSession, root: str) -> DataFrame:
    turns = read_table(spark, root, "conversations")
    parts = []
    asked = F.col("role") == "user"
    for name, rows, y in (("user", asked, "1"), ("others", ~asked, "0")):
        path = scratch_dir(spark, name)
        tb.write_csv(turns.filter(rows).select("text", F.lit(y).alias("Y")), path)
        parts.append(tb.read_csv(spark, path, TEXT_Y_CSV))
    both = tb.union_all(parts[0], parts[1].select("Y", "text"))
    return rel.rename_columns(both, {"Y": "label", "text": "comment"})


@query("load_comments", """
  SELECT sha256(text || chr(31) || CAST(quality AS VARCHAR)) || '-' || row_number() OVER (PARTITION BY text, quality) AS id,
         text AS comment, CAST(quality AS DOUBLE) AS label FROM documents JOIN labels USING (doc_id)""")
def load_comments(spark: SparkSession, root: str) -> DataFrame:
    path = scratch_dir(spark, "comments")
    rows = documents(spark, root).join(read_table(spark, root, "labels"), "doc_id")
    blank = [F.lit("x").alias(c) for c in COMMENT_COLUMNS[2:]]
    tb.write_csv(rows.select(F.col("quality").cast("string").alias("label"), F.col("text").alias("comment"), *blank), path)
    loaded = tb.load_comments(spark, path, COMMENTS_CSV)
    return loaded.withColumn("label", F.col("label").cast("double"))


@query("feature_roundtrip", f"""
  SELECT vec_id AS id, CASE WHEN label < 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label,
         CAST(len(embedding) AS INTEGER) AS dims,
         round({' + '.join(f'CAST(embedding[{i + 1}] AS DOUBLE)' for i in range(DIM))}, 6) AS total
  FROM embeddings""")
def feature_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    path = scratch_dir(spark, "features")
    source = vectors(spark, root)
    tb.write_features(source, path)
    back = tb.read_features(spark, path, source.schema)
    return back.select("id", F.col("label").cast("double").alias("label"),
                       F.size("features").alias("dims"), _total("features"))


def _total(values: str):
    return F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double")), 6) \
        .alias("total")


def _requests(spark: SparkSession, root: str) -> DataFrame:
    return requests(spread(documents(spark, root), "doc_id"))


@query("request_parse", """
  SELECT doc_id AS request_id, CAST(doc_id AS VARCHAR) AS id, text AS comment FROM documents""")
def request_parse(spark: SparkSession, root: str) -> DataFrame:
    return rq.accepted_comments(rq.parse_requests(_requests(spark, root)), ("request_id",))


@query("request_reject", """
  SELECT -doc_id - 1 AS request_id,
         CASE lang WHEN 'fr' THEN 'missing_textComments' ELSE 'not_json' END AS reject_reason
  FROM documents WHERE lang IN ('fr', 'de')""")
def request_reject(spark: SparkSession, root: str) -> DataFrame:
    rejected = rq.rejected_requests(rq.parse_requests(_requests(spark, root)))
    return rejected.select("request_id", "reject_reason")


@query("response_json", """
  SELECT doc_id AS id,
         '{"prediction":' || CASE quality WHEN 1 THEN '1.0' ELSE '0.0' END ||
         ',"id":' || CAST(doc_id AS VARCHAR) || '}' AS response
  FROM labels""")
def response_json(spark: SparkSession, root: str) -> DataFrame:
    scored = read_table(spark, root, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("prediction"))
    return scored.select("id", rq.response_json().alias("response"))


# --- projections, casts, filters ---------------------------------------------


@query("project_columns", "SELECT doc_id, text FROM documents")
def project_columns(spark: SparkSession, root: str) -> DataFrame:
    return rel.project_columns(documents(spark, root), ["doc_id", "text"])


@query("rename_columns", """
  SELECT doc_id AS id, text AS comment, lang, source AS label, n_chars FROM documents""")
def rename_columns(spark: SparkSession, root: str) -> DataFrame:
    return rel.rename_columns(documents(spark, root),
                              {"doc_id": "id", "text": "comment", "source": "label"})


@query("drop_nulls", """
  SELECT d.doc_id AS id, d.text AS comment, l.quality AS label, d.lang
  FROM documents d LEFT JOIN labels l USING (doc_id)
  WHERE d.text IS NOT NULL AND l.quality IS NOT NULL""")
def drop_nulls(spark: SparkSession, root: str) -> DataFrame:
    return rel.drop_nulls(maybe_labelled(spark, root))


@query("null_report", """
  WITH j AS (SELECT d.text AS comment, l.quality AS label
             FROM documents d LEFT JOIN labels l USING (doc_id))
  SELECT 'comment' AS column_name, count(*) FILTER (comment IS NULL) AS nulls, count(*) AS total FROM j
  UNION ALL
  SELECT 'label', count(*) FILTER (label IS NULL), count(*) FROM j""")
def null_report(spark: SparkSession, root: str) -> DataFrame:
    return rel.null_report(maybe_labelled(spark, root), ["comment", "label"])


# Where a document has no label its language code stands in as a bad label.
_MIXED = "SELECT d.doc_id AS id, coalesce(CAST(l.quality AS VARCHAR), d.lang) AS label, " \
         "d.n_chars, d.lang FROM documents d LEFT JOIN labels l USING (doc_id)"


def _mixed_labels(spark: SparkSession, root: str) -> DataFrame:
    return maybe_labelled(spark, root).select(
        "id", F.coalesce(F.col("label").cast("string"), "lang").alias("label"), "lang", "comment")


@query("label_filter", f"SELECT id, label FROM ({_MIXED}) WHERE TRY_CAST(label AS FLOAT) = 0")
def label_filter(spark: SparkSession, root: str) -> DataFrame:
    return rel.with_label(_mixed_labels(spark, root), 0).select("id", "label")


@query("cast_float", f"""
  SELECT id, CAST(TRY_CAST(label AS FLOAT) AS DOUBLE) AS label,
         CAST(TRY_CAST(label AS FLOAT) AS DOUBLE) AS f_0,
         CAST(TRY_CAST(lang AS FLOAT) AS DOUBLE) AS f_1,
         CAST(CAST(id AS FLOAT) AS DOUBLE) AS f_2
  FROM ({_MIXED})""")
def cast_float(spark: SparkSession, root: str) -> DataFrame:
    texts = F.array(F.col("label"), F.col("lang"), F.col("id").cast("string"))
    out = _mixed_labels(spark, root).select(
        "id", label_as_float("label").cast("double").alias("label"), floats(texts).alias("f"))
    return out.select("id", "label", *[F.get("f", F.lit(i)).cast("double").alias(f"f_{i}")
                                       for i in range(3)])


@query("nonempty_tokens", f"""
  SELECT doc_id AS id, 0 AS kind, CAST(len({q.clean_tokens('text')}) AS INTEGER) AS n_tokens FROM documents
  WHERE len({q.clean_tokens('text')}) > 0""")
def nonempty_tokens(spark: SparkSession, root: str) -> DataFrame:
    # The tokens of every document, and beside them three kinds of empty lists.
    kinds = F.array(tx.clean_tokens("comment"), F.array().cast("array<string>"), F.array(F.lit("")),
                    F.array(F.lit(None).cast("string")), F.lit(None).cast("array<string>"))
    tagged = texts(spark, root).select("id", F.posexplode(kinds).alias("kind", "tokens"))
    return rel.nonempty_tokens(tagged).select("id", "kind", F.size("tokens").alias("n_tokens"))


@query("vector_to_columns", "SELECT vec_id AS id, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS f_{i}" for i in range(DIM + 1)) + " FROM embeddings")
def vector_to_columns(spark: SparkSession, root: str) -> DataFrame:
    wide = vectors(spark, root).withColumn("features", F.col("features").cast("array<double>"))
    return wide.select("id", *element_columns("features", DIM + 1))


@query("assemble_skip", f"""
  SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS dims,
         round({' + '.join(f'CAST(embedding[{i + 1}] AS DOUBLE)' for i in range(DIM))}, 6) AS total
  FROM embeddings WHERE NOT list_bool_or(list_transform(embedding, lambda x : x > 0.3 OR x < -0.3))""")
def assemble_skip(spark: SparkSession, root: str) -> DataFrame:
    # Large values become null, very small ones NaN: both must drop the row.
    holed = vectors(spark, root).withColumn("features", F.transform(
        "features", lambda x: F.when(x > 0.3, F.lit(None))
        .when(x < -0.3, F.lit(float("nan"))).otherwise(x.cast("double"))))
    kept = weights.assemble(holed)
    back = kept.select("id", vector_to_array("features").alias("f"))
    return back.select("id", F.size("f").alias("dims"), _total("f"))


@query("assemble_columns", """
  SELECT l_orderkey, l_linenumber, round(l_quantity + l_extendedprice + l_discount, 6) AS total
  FROM lineitem WHERE l_discount <> 0""")
def assemble_columns(spark: SparkSession, root: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    items = spark.read.parquet(f"{root}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("a"),
        F.col("l_extendedprice").cast("double").alias("b"),
        F.nullif(F.col("l_discount").cast("double"), F.lit(0.0)).alias("c"))
    out = VectorAssembler(inputCols=["a", "b", "c"], outputCol="v",
                          handleInvalid="skip").transform(items)
    return out.select("l_orderkey", "l_linenumber", vector_to_array("v").alias("v")) \
        .select("l_orderkey", "l_linenumber", _total("v"))


@query("label_message", """
  SELECT doc_id AS id, CASE quality WHEN 1 THEN 'It''s just SARCASM' ELSE 'It''s NOT sarcasm' END AS message
  FROM labels""")
def label_message(spark: SparkSession, root: str) -> DataFrame:
    scored = read_table(spark, root, "labels")
    return scored.select(F.col("doc_id").alias("id"),
                         rel.label_message(F.col("quality").cast("double")).alias("message"))


@query("vector_array_roundtrip", f"""
  SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS dims,
         round({' + '.join(f'CAST(embedding[{i + 1}] AS DOUBLE)' for i in range(DIM))}, 6) AS total
  FROM embeddings""")
def vector_array_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    back = vectors(spark, root).select(
        "id", vector_to_array(array_to_vector("features"), "float32").alias("f"))
    return back.select("id", F.size("f").alias("dims"), _total("f"))


@query("explode_embeddings", """
  SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[64] AS DOUBLE) AS last
  FROM embeddings WHERE label <> 0""")
def explode_embeddings(spark: SparkSession, root: str) -> DataFrame:
    none = F.array().cast("array<array<float>>")
    nested = read_table(spark, root, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.when(F.col("label") != 0, F.array("embedding")).otherwise(none).alias("results"))
    flat = nested.select("id", F.explode("results").alias("f"))
    return flat.select("id", F.get("f", F.lit(0)).cast("double").alias("first"),
                       F.get("f", F.lit(DIM - 1)).cast("double").alias("last"))


# --- joins ---------------------------------------------------------------------

_DEDUPED = "SELECT text AS comment, source AS label, min(doc_id) AS id FROM documents GROUP BY ALL"
_CONSISTENT = f"""
  WITH d AS ({_DEDUPED})
  SELECT id, comment, label FROM d
  WHERE comment NOT IN (SELECT comment FROM d GROUP BY comment HAVING count(*) > 1)"""


@query("conflict_anti_join", _CONSISTENT)
def conflict_anti_join(spark: SparkSession, root: str) -> DataFrame:
    unique = curate.dedupe_labelled(sourced(spark, root), "comment")
    return curate.conflict_anti_join(unique, "comment").select("id", "comment", "label")


@query("conflict_filter", _CONSISTENT)
def conflict_filter(spark: SparkSession, root: str) -> DataFrame:
    return curate.conflict_filter(sourced(spark, root), "comment").select("id", "comment", "label")


@query("conflict_filter_tokens", f"""
  WITH t AS (SELECT doc_id, source, {q.clean_tokens('text')} AS tokens FROM documents),
  d AS (SELECT tokens, min(source) AS label, min(doc_id) AS id FROM t WHERE len(tokens) > 0
        GROUP BY tokens HAVING count(DISTINCT source) = 1)
  SELECT id, label, CAST(len(tokens) AS INTEGER) AS n_tokens FROM d""")
def conflict_filter_tokens(spark: SparkSession, root: str) -> DataFrame:
    tokens = sourced(spark, root).withColumn("tokens", tx.clean_tokens("comment"))
    kept = curate.conflict_filter(rel.nonempty_tokens(tokens), "tokens")
    return kept.select("id", "label", F.size("tokens").alias("n_tokens"))


@query("skip_scored", """
  SELECT doc_id AS id, text AS comment FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def skip_scored(spark: SparkSession, root: str) -> DataFrame:
    comments = documents(spark, root).select(F.col("doc_id").alias("id"),
                                             F.col("text").alias("comment"))
    scored = read_table(spark, root, "labels").select(F.col("doc_id").alias("id"))
    return rel.skip_known(comments, scored)


@query("attach_prediction", """
  SELECT doc_id AS id, text AS comment, CAST(quality AS DOUBLE) AS prediction
  FROM documents JOIN labels USING (doc_id)""")
def attach_prediction(spark: SparkSession, root: str) -> DataFrame:
    comments = documents(spark, root).select(F.col("doc_id").alias("id"),
                                             F.col("text").alias("comment"))
    predictions = read_table(spark, root, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("prediction"))
    return rel.attach_predictions(comments, predictions)


# --- counts, duplicates, sampling -------------------------------------------------


@query("row_counts", """
  SELECT 'loaded' AS stage, count(*) AS n_rows FROM documents
  UNION ALL SELECT 'labelled', count(*) FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT 'deduplicated', count(*) FROM (SELECT DISTINCT text, source FROM documents)""")
def row_counts(spark: SparkSession, root: str) -> DataFrame:
    return rel.row_counts({
        "loaded": documents(spark, root), "labelled": labelled(spark, root),
        "deduplicated": curate.dedupe_labelled(sourced(spark, root), "comment")})


_QUALITY_SQL = f"""
  WITH l AS (SELECT d.text AS comment, l.quality AS label FROM documents d LEFT JOIN labels l USING (doc_id)),
  k AS (SELECT * FROM l WHERE comment IS NOT NULL AND label IS NOT NULL),
  t AS (SELECT * FROM k WHERE len({q.clean_tokens('comment')}) > 0)"""


@query("quality_report", _QUALITY_SQL + "".join(f"""
  {'UNION ALL' if n else ''} SELECT '{stage}' AS stage, unnest(['rows', 'nulls:label', 'label=0', 'label=1']) AS metric,
    unnest([count(*), count(*) FILTER (label IS NULL), count(*) FILTER (label = 0), count(*) FILTER (label = 1)]) AS value FROM {t}"""
    for n, (stage, t) in enumerate((("loaded", "l"), ("labelled", "k"), ("with tokens", "t")))))
def quality_report(spark: SparkSession, root: str) -> DataFrame:
    """Counts of all stages of one job, which is run once and reads each table once."""
    report, watch = quality.QualityReport(), {"columns": ["label"], "classes": {"label": [0, 1]}}
    rows = report.watch("loaded", maybe_labelled(spark, root), **watch)
    rows = report.watch("labelled", rel.drop_nulls(rows), **watch)
    tokens = rel.nonempty_tokens(rows.withColumn("tokens", tx.clean_tokens("comment")))
    report.watch("with tokens", tokens, **watch).write.parquet(scratch_dir(spark, "quality"))
    return report.table(spark)


@query("dedupe_labelled", f"SELECT id, comment, label FROM ({_DEDUPED})")
def dedupe_labelled(spark: SparkSession, root: str) -> DataFrame:
    return curate.dedupe_labelled(sourced(spark, root), "comment").select("id", "comment", "label")


@query("conflict_keys", """
  SELECT text AS comment, count(DISTINCT source) AS n_labels FROM documents
  GROUP BY text HAVING count(DISTINCT source) > 1""")
def conflict_keys(spark: SparkSession, root: str) -> DataFrame:
    return curate.conflict_keys(sourced(spark, root), "comment")


@query("class_distribution", f"""
  SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
  FROM ({LABELLED_SQL}) GROUP BY label""")
def class_distribution(spark: SparkSession, root: str) -> DataFrame:
    out = rel.class_distribution(labelled(spark, root))
    return out.select(F.col("label").cast("double").alias("label"), "n",
                      F.round("share", 6).alias("share"))


@query("sample_fraction", f"""
  SELECT doc_id AS id, text AS comment, source AS label FROM documents
  WHERE {q.bucket('doc_id', 1_000_000)} < 100000""")
def sample_fraction(spark: SparkSession, root: str) -> DataFrame:
    return sampling.sample_fraction(sourced(spark, root))


@query("train_test_split", f"""
  SELECT doc_id AS id, CASE WHEN {q.bucket('doc_id', 100)} < 80 THEN 'train' ELSE 'test' END AS part
  FROM documents""")
def train_test_split(spark: SparkSession, root: str) -> DataFrame:
    train, test = sampling.train_test_split(sourced(spark, root))
    return (train.select("id", F.lit("train").alias("part"))
            .unionAll(test.select("id", F.lit("test").alias("part"))))


@query("cv_folds", f"""
  SELECT doc_id AS id, CAST({q.bucket('doc_id', 5, 'fold-42')} AS INTEGER) AS fold
  FROM documents""")
def cv_folds(spark: SparkSession, root: str) -> DataFrame:
    return sampling.with_fold(sourced(spark, root)).select("id", "fold")


@query("balance_classes", f"""
  WITH r AS (SELECT d.doc_id AS id, CAST(l.toxic AS DOUBLE) AS label,
                    row_number() OVER (PARTITION BY l.toxic ORDER BY {q.hash32('d.doc_id')}, d.doc_id) AS rn
             FROM documents d JOIN labels l USING (doc_id))
  SELECT id, label FROM r
  WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM r GROUP BY label))""")
def balance_classes(spark: SparkSession, root: str) -> DataFrame:
    return sampling.balance_classes(labelled(spark, root, "toxic")).select(
        "id", F.col("label").cast("double").alias("label"))


@query("shuffle_order", f"""
  SELECT doc_id AS id, {q.digest('doc_id')} AS sort_key,
         row_number() OVER (ORDER BY {q.digest('doc_id')}, doc_id) AS position FROM documents""")
def shuffle_order(spark: SparkSession, root: str) -> DataFrame:
    return sampling.shuffle_order(sourced(spark, root), position="position").select(
        "id", row_digest("id").alias("sort_key"), "position")


# --- text and tokens -----------------------------------------------------------------


@query("text_clean", f"SELECT doc_id AS id, {q.clean('text')} AS comment FROM documents")
def text_clean(spark: SparkSession, root: str) -> DataFrame:
    return texts(spark, root).withColumn("comment", tx.clean_text("comment"))


@query("text_clean_unicode", "SELECT doc_id AS id, " + q.clean("text", r"[^\p{L}\p{N}_\s]")
       + " AS comment FROM documents")
def text_clean_unicode(spark: SparkSession, root: str) -> DataFrame:
    return texts(spark, root).withColumn("comment", tx.clean_text("comment", unicode=True))


def _token_columns(tokens):
    return F.size(tokens).alias("n_tokens"), F.array_join(tokens, " ").alias("tokens")


def _token_sql(tokens: str) -> str:
    return f"""
  SELECT doc_id AS id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, ' ') AS tokens
  FROM (SELECT doc_id, {tokens} AS t FROM documents)"""


@query("tokenize", _token_sql(q.tokens("text")))
def tokenize(spark: SparkSession, root: str) -> DataFrame:
    return texts(spark, root).select("id", tx.tokenize("comment").alias("t")) \
        .select("id", *_token_columns("t"))


@query("normalize_tokens", _token_sql(q.normalized("text")))
def normalize_tokens(spark: SparkSession, root: str) -> DataFrame:
    return texts(spark, root).select(
        "id", tx.normalize_tokens(tx.tokenize("comment")).alias("t")) \
        .select("id", *_token_columns("t"))


@query("remove_stopwords", _token_sql(q.without_stopwords(q.tokens("text"))))
def remove_stopwords(spark: SparkSession, root: str) -> DataFrame:
    return texts(spark, root).select(
        "id", tx.remove_stopwords(tx.tokenize("comment")).alias("t")) \
        .select("id", *_token_columns("t"))


@query("clean_tokens", _token_sql(q.lemma_tokens("text")))
def clean_tokens(spark: SparkSession, root: str) -> DataFrame:
    lemmas = suffix_dictionary(_normalized(spark, root))
    return tok.comment_tokens(texts(spark, root), lemmas).select("id", *_token_columns("tokens"))


def _normalized(spark: SparkSession, root: str) -> DataFrame:
    return texts(spark, root).select("id", tx.normalized_tokens("comment").alias("tokens"))


@query("lemmatize", _token_sql(q.lemmatized(q.normalized("text"))))
def lemmatize(spark: SparkSession, root: str) -> DataFrame:
    tokens = _normalized(spark, root)
    return tok.lemmatize(tokens, suffix_dictionary(tokens)).select("id", *_token_columns("tokens"))


@query("remove_stopword_table", f"""
  WITH t AS (SELECT doc_id, {q.normalized('text')} AS w FROM documents),
  e AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM t),
  stop AS (SELECT term FROM (SELECT DISTINCT doc_id, term FROM e) GROUP BY term
           HAVING count(*) > 0.4 * (SELECT count(*) FROM documents)),
  k AS (SELECT * FROM e WHERE term NOT IN (SELECT term FROM stop))
  SELECT t.doc_id AS id, CAST(count(k.term) AS INTEGER) AS n_tokens,
         coalesce(string_agg(k.term, ' ' ORDER BY k.pos), '') AS tokens
  FROM t LEFT JOIN k USING (doc_id) GROUP BY t.doc_id""")
def remove_stopword_table(spark: SparkSession, root: str) -> DataFrame:
    tokens = _normalized(spark, root)
    n = tokens.agg(F.count("*")).scalar()
    common = weights.document_frequency(tokens).filter(F.col("df") > F.lit(0.4) * n).select("term")
    return tok.remove_stopword_table(tokens, common).select("id", *_token_columns("tokens"))
