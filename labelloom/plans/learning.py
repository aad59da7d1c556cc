"""Queries on term weights, features, classifiers and evaluation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions import text as tx
from labelloom.operators import classify, evaluate as ev, relational as rel, weights, word_vectors
from labelloom.operators.feature_sets import TFIDF_BUCKETS, feature_set
from labelloom.operators.sampling import train_test_split
from labelloom.operators.word_vectors import MIN_COUNT, WINDOW
from labelloom.plans import sqltext as q
from labelloom.plans.experiment import run_matrix
from labelloom.plans.inputs import (FIXED_PREDICTIONS_SQL, FIXED_SCORE_SQL, LABELLED_SQL, documents,
                                    fixed_predictions, fixed_score, labelled, suffix_dictionary, texts, vectors)
from labelloom.plans.prepare import fit_once, sentence_corpus, token_corpus
from labelloom.plans.ledger import Ledger
from labelloom.plans.registry import query
from labelloom.session import materialize, scratch_dir
from labelloom.sources.models import load_pipeline, save_model
from labelloom.sources.tables import read_table

# The reference's families; the words of the pre-trained one come from a stand-in table of this width.
MATRIX_FAMILIES = ("tfidf", "word2vec", "pretrained_words", "encoder_tokens", "encoder_sentence")
MATRIX_WORD_DIM = 300

# --- the load-and-clean half of a training run -----------------------------------


@query("flagship", f"""
  WITH t AS (SELECT id, label, {q.lemma_tokens('comment')} AS tokens FROM ({LABELLED_SQL})
             WHERE comment IS NOT NULL AND label IS NOT NULL),
  k AS (SELECT min(label) AS label FROM t WHERE len(tokens) > 0
        GROUP BY tokens HAVING count(DISTINCT label) = 1)
  SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
  FROM k GROUP BY label""")
def flagship(spark: SparkSession, root: str) -> DataFrame:
    rows = labelled(spark, root)
    lemmas = suffix_dictionary(rows.select(tx.normalized_tokens("comment").alias("tokens")))
    out = rel.class_distribution(token_corpus(rows, lemmas=lemmas))
    return out.select(F.col("label").cast("double").alias("label"), "n",
                      F.round("share", 6).alias("share"))


# --- term weights, scaling, pooling --------------------------------------------------


def _tokens(spark: SparkSession, root: str) -> DataFrame:
    return texts(spark, root).select("id", tx.clean_tokens("comment").alias("tokens"))


_TERMS = f"SELECT doc_id AS id, unnest({q.clean_tokens('text')}) AS term FROM documents"


@query("term_frequency", f"SELECT id, term, count(*) AS tf FROM ({_TERMS}) GROUP BY id, term")
def term_frequency(spark: SparkSession, root: str) -> DataFrame:
    return weights.term_frequency(_tokens(spark, root))


@query("document_frequency",
       f"SELECT term, count(DISTINCT id) AS df FROM ({_TERMS}) GROUP BY term")
def document_frequency(spark: SparkSession, root: str) -> DataFrame:
    return weights.document_frequency(_tokens(spark, root))


@query("tfidf", f"""
  WITH tf AS (SELECT id, term, count(*) AS tf FROM ({_TERMS}) GROUP BY id, term),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  n AS (SELECT count(*) AS n FROM documents)
  SELECT id, term, tf, round(tf * ln((n + 1) / (df + 1)), 6) + 0.0 AS weight
  FROM tf JOIN df USING (term), n""")
def tfidf(spark: SparkSession, root: str) -> DataFrame:
    return weights.tfidf(_tokens(spark, root)).withColumn("weight", F.round("weight", 6))


def _long(df: DataFrame, values: str = "features") -> DataFrame:
    """(id, pos, value) with values rounded, for comparison."""
    return (df.select("id", F.posexplode(values).alias("pos", "value"))
            .withColumn("value", F.round(F.col("value").cast("double"), 6) + F.lit(0.0)))


_ELEMENTS = "SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, " \
            "CAST(unnest(range(len(embedding))) AS INTEGER) AS pos FROM embeddings"


@query("standardize", f"""
  WITH e AS ({_ELEMENTS}),
  s AS (SELECT pos, avg(x) AS m, stddev_samp(x) AS sd FROM e GROUP BY pos)
  SELECT vec_id AS id, pos, round(CASE WHEN sd = 0 THEN 0 ELSE (x - m) / sd END, 6) + 0.0 AS value
  FROM e JOIN s USING (pos)""")
def standardize(spark: SparkSession, root: str) -> DataFrame:
    return _long(weights.standardize(vectors(spark, root)))


@query("mean_pool", f"""
  SELECT CAST(label AS BIGINT) AS id, pos, round(avg(x), 6) + 0.0 AS value
  FROM ({_ELEMENTS}) GROUP BY label, pos""")
def mean_pool(spark: SparkSession, root: str) -> DataFrame:
    # The label plays the document, each embedding one of its token vectors.
    token_vectors = read_table(spark, root, "embeddings").select(
        F.col("label").cast("bigint").alias("id"), F.col("embedding").alias("vector"))
    return _long(weights.mean_pool(token_vectors))


_WORD_DIM = 8


def _word_vectors(tokens: DataFrame, dim: int = _WORD_DIM) -> DataFrame:
    """A stand-in word-vector table: corpus words of four letters and more."""
    def block(first: int) -> Column:
        digest = F.md5("word") if first == 0 else F.md5(F.concat("word", F.lit(f" {first}")))
        here = min(_WORD_DIM, dim - first)
        return F.transform(F.array(digest), lambda d: F.array(*[
            (F.conv(F.substring(d, 4 * i + 1, 4), 16, 10).cast("double") / 65535.0 - 0.5).cast("float") for i in range(here)]))
    vector = F.flatten(F.concat(*[block(i) for i in range(0, dim, _WORD_DIM)]))
    return (rel.exploded(tokens, [], F.array_distinct("tokens"), "word").distinct()
            .filter(F.length("word") >= 4).select("word", vector.alias("vector")))


@query("features_pretrained_words", f"""
  WITH e AS (SELECT t.id, CAST(r.i AS INTEGER) AS pos,
                    CAST(CAST(CAST(('0x' || substr(md5(term), 4 * r.i + 1, 4)) AS BIGINT) AS DOUBLE)
                         / 65535.0::DOUBLE - 0.5::DOUBLE AS FLOAT) AS x
             FROM ({_TERMS}) t, (SELECT unnest(range({_WORD_DIM})) AS i) r WHERE length(term) >= 4)
  SELECT id, pos, round(avg(CAST(x AS DOUBLE)), 6) + 0.0 AS value FROM e GROUP BY id, pos""")
def features_pretrained_words(spark: SparkSession, root: str) -> DataFrame:
    # Both are read by several jobs, which would clean and split all texts again.
    tokens = materialize(_tokens(spark, root), "tokens")
    return _long(weights.pooled_word_vectors(tokens, materialize(_word_vectors(tokens), "word-vectors")))


# --- fitted feature families ------------------------------------------------------------


@query("hashing_tf", f"""
  SELECT doc_id AS id, CAST(len({q.clean_tokens('text')}) AS BIGINT) AS n_tokens FROM documents""")
def hashing_tf(spark: SparkSession, root: str) -> DataFrame:
    # Which slot a token gets is Spark's choice; that none gets lost is checked.
    hashed = HashingTF(numFeatures=TFIDF_BUCKETS, inputCol="tokens", outputCol="tf").transform(
        _tokens(spark, root))
    # The counts of the slots in use, without writing out the others.
    total = F.aggregate(F.unwrap_udt("tf")["values"], F.lit(0.0), lambda a, x: a + x)
    return hashed.select("id", total.cast("bigint").alias("n_tokens"))


def _features(spark: SparkSession, root: str, name: str, **options) -> DataFrame:
    """Width, finiteness and norm of the features of all documents; their values are
    Spark's or the encoder's."""
    corpus = materialize(texts(spark, root), "corpus")
    model = fit_once(feature_set(name, **options), corpus)
    v = model.transform(corpus).select("id", vector_to_array("features").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return v.select("id", F.size("v").cast("bigint").alias("width"),
                    F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)).alias("is_finite"), norm.alias("norm"))


def _width_sql(width: int, unit: bool = False, where: str = "") -> str:
    return f"""SELECT doc_id AS id, CAST({width} AS BIGINT) AS width, true AS is_finite
               {', true AS unit_norm' if unit else ''} FROM documents {where}"""


@query("features_tfidf", _width_sql(500))
def features_tfidf(spark: SparkSession, root: str) -> DataFrame:
    return _features(spark, root, "tfidf").drop("norm")


_VARIANCES = " + ".join(f"var_samp(CAST(embedding[{i + 1}] AS DOUBLE))" for i in range(64))


@query("pca_features", f"""
  SELECT CAST(64 AS BIGINT) AS n_axes, CAST(count(*) AS BIGINT) AS n_rows, round({_VARIANCES}, 4) AS total_variance,
         true AS is_falling, true AS is_orthogonal FROM embeddings""")
def pca_features(spark: SparkSession, root: str) -> DataFrame:
    """All axes keep the whole variance, none more than the one before, and don't correlate."""
    v = vectors(spark, root).withColumn("features", array_to_vector("features"))
    out = PCA(k=64, inputCol="features", outputCol="pca").fit(v).transform(v).select(vector_to_array("pca").alias("p"))
    values = [F.col("p")[i] for i in range(64)]
    both = out.select(*[x.alias(f"p{i}") for i, x in enumerate(values)])
    sums = both.agg(F.count("*").alias("n_rows"), F.array(*[F.var_samp(f"p{i}") for i in range(64)]).alias("v"),
                    *[F.corr(f"p{i}", f"p{i + 1}").alias(f"c{i}") for i in range(63)])
    falling = [F.col("v")[i] >= F.col("v")[i + 1] - 1e-9 for i in range(63)]
    return sums.select(
        F.lit(64).cast("bigint").alias("n_axes"), "n_rows",
        F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total_variance"),
        F.forall(F.array(*falling), lambda x: x).alias("is_falling"),
        (F.greatest(*[F.abs(f"c{i}") for i in range(63)]) < 1e-6).alias("is_orthogonal"))


@query("features_word2vec", _width_sql(300))
def features_word2vec(spark: SparkSession, root: str) -> DataFrame:
    return _features(spark, root, "word2vec").drop("norm")


_MEETINGS = f"""
  WITH t AS (SELECT doc_id, {q.clean_tokens('text')} AS w FROM documents),
  e AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM t),
  m AS (SELECT x.term AS a, y.term AS b FROM e x, range(1, {WINDOW + 1}) r(o)
        JOIN e y ON y.doc_id = x.doc_id AND y.pos = x.pos + o),
  c AS (SELECT word, context, count(*) AS n FROM (SELECT a AS word, b AS context FROM m UNION ALL SELECT b, a FROM m)
        GROUP BY word, context)"""


@query("cooccurrences", f"""{_MEETINGS}
  SELECT word, count(*) AS n_contexts, CAST(sum(n) AS BIGINT) AS n_meetings, max(n) AS most FROM c GROUP BY word""")
def cooccurrences(spark: SparkSession, root: str) -> DataFrame:
    codes, names = word_vectors.word_codes(_tokens(spark, root))
    return word_vectors.named(word_vectors.cooccurrences(codes).groupBy("word").agg(
        F.count("*").alias("n_contexts"), F.sum("n").alias("n_meetings"), F.max("n").alias("most")), names)


@query("word_pmi", f"""{_MEETINGS},
  kept AS (SELECT word FROM c GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
  i AS (SELECT * FROM c WHERE word IN (SELECT word FROM kept) AND context IN (SELECT word FROM kept)),
  s AS (SELECT word, sum(n) AS n FROM i GROUP BY word),
  p AS (SELECT i.word, ln(CAST(i.n AS DOUBLE) * (SELECT CAST(sum(n) AS DOUBLE) FROM s) / (CAST(x.n AS DOUBLE) * y.n)) AS pmi
        FROM i JOIN s x ON x.word = i.word JOIN s y ON y.word = i.context)
  SELECT word, count(*) AS n_contexts, round(max(pmi), 6) AS highest, round(avg(pmi), 5) AS mean FROM p WHERE pmi > 1e-9 GROUP BY word""")
def word_pmi(spark: SparkSession, root: str) -> DataFrame:
    codes, names = word_vectors.word_codes(_tokens(spark, root))
    counts = word_vectors.cooccurrences(codes, written=True)
    return word_vectors.named(word_vectors.word_pmi(counts).where("pmi > 1e-9").groupBy("word").agg(
        F.count("*").alias("n_contexts"), F.round(F.max("pmi"), 6).alias("highest"), F.round(F.avg("pmi"), 5).alias("mean")), names)


@query("features_word_pmi", f"""{_MEETINGS}
  SELECT DISTINCT doc_id AS id, CAST(300 AS BIGINT) AS width, true AS is_finite FROM e
  WHERE term IN (SELECT word FROM c GROUP BY word HAVING sum(n) >= {MIN_COUNT})""")
def features_word_pmi(spark: SparkSession, root: str) -> DataFrame:
    # Documents of rare words only have no vector.
    return _features(spark, root, "word_pmi").drop("norm")


@query("features_encoder_tokens", _width_sql(768, where=f"WHERE len({q.clean_tokens('text')}) > 0"))
def features_encoder_tokens(spark: SparkSession, root: str) -> DataFrame:
    return _features(spark, root, "encoder_tokens").drop("norm")


@query("features_encoder_sentence", _width_sql(768, unit=True))
def features_encoder_sentence(spark: SparkSession, root: str) -> DataFrame:
    rows = _features(spark, root, "encoder_sentence")
    return rows.select("id", "width", "is_finite", (F.abs(F.col("norm") - 1) < 1e-4).alias("unit_norm"))


def _vector_digest(column: str) -> Column:
    """128 bits of a vector's values, the same for values that are equal; null for none."""
    parts = F.unwrap_udt(column)
    return F.when(F.col(column).isNotNull(), F.struct(F.xxhash64(F.lit(1), parts), F.xxhash64(F.lit(2), parts)))


def _all_equal(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    # Vectors are compared by digests, so that whole ones need not meet in a shuffle.
    pairs = before.select("id", _vector_digest(column).alias("_a")).join(
        after.select("id", _vector_digest(column).alias("_b")), "id")
    return pairs.agg(F.count("*").alias("n_rows"),
                     F.count_if(F.col("_a") == F.col("_b")).alias("n_equal"))


@query("stages_roundtrip", """
  SELECT count(*) AS n_rows, count(*) AS n_equal FROM documents""")
def stages_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    corpus = materialize(texts(spark, root), "corpus")
    model = fit_once(feature_set("tfidf"), corpus)
    back = load_pipeline(save_model(model, scratch_dir(spark, "stages")))
    return _all_equal(model.transform(corpus), back.transform(corpus), "features")


# --- classifiers ------------------------------------------------------------------------------


def _split_vectors(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    v = vectors(spark, root).withColumn("features", array_to_vector("features"))
    train, test = train_test_split(v)
    return materialize(train, "train"), test


def _classified(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Tuned over the whole grid in five folds; which class wins is Spark's affair, but
    every held-out row gets one of the two, and the saved model gives the same."""
    train, test = _split_vectors(spark, root)
    model = classify.fit_classifier(name, train)
    scored = classify.score(model, test)
    back = load_pipeline(save_model(PipelineModel([model]), scratch_dir(spark, f"classifier-{name}")))
    again = back.transform(test).select("id", F.col("prediction").alias("again"))
    return scored.join(again, "id").select(
        "id", F.col("label").cast("double").alias("label"), F.col("prediction").isin(0.0, 1.0).alias("is_class"),
        (F.col("prediction") == F.col("again")).alias("same_when_loaded"))


_HELD_OUT_SQL = f"""
  SELECT vec_id AS id, CASE WHEN label < 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label,
         true AS is_class, true AS same_when_loaded
  FROM embeddings WHERE {q.bucket('vec_id', 100)} >= 80"""


@query("clf_logistic", _HELD_OUT_SQL)
def clf_logistic(spark: SparkSession, root: str) -> DataFrame:
    return _classified(spark, root, "logistic")


@query("clf_forest", _HELD_OUT_SQL)
def clf_forest(spark: SparkSession, root: str) -> DataFrame:
    return _classified(spark, root, "forest")


@query("clf_svc", _HELD_OUT_SQL)
def clf_svc(spark: SparkSession, root: str) -> DataFrame:
    return _classified(spark, root, "svc")


@query("clf_mlp", _HELD_OUT_SQL)
def clf_mlp(spark: SparkSession, root: str) -> DataFrame:
    return _classified(spark, root, "mlp")


@query("cv_scores", """
  SELECT 'elasticNetParam=' || e || ', regParam=' || r AS params, true AS in_range
  FROM (VALUES ('0.5'), ('0.8'), ('1.0')) a(e), (VALUES ('0.0'), ('0.05'), ('0.1')) b(r)""")
def cv_scores(spark: SparkSession, root: str) -> DataFrame:
    train, _ = _split_vectors(spark, root)
    scores = spark.createDataFrame(classify.cv_scores(classify.cross_validate("logistic", train)),
                                   "params string, mean_auroc double, rank int")
    return scores.select("params", (F.col("mean_auroc").between(0, 1) & F.col("rank").between(1, 9)).alias("in_range"))


@query("model_roundtrip", f"""
  SELECT count(*) AS n_rows, count(*) AS n_equal FROM embeddings
  WHERE {q.bucket('vec_id', 100)} >= 80""")
def model_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    train, test = _split_vectors(spark, root)
    model = Pipeline(stages=[classify.make_classifier("mlp", classify.feature_width(train))]).fit(train)
    back = load_pipeline(save_model(model, scratch_dir(spark, "model")))
    return _all_equal(model.transform(test), back.transform(test), "rawPrediction")


@query("score_fixed_logistic", f"""
  SELECT vec_id AS id, round(p, 6) AS probability,
         CASE WHEN p >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction
  FROM (SELECT vec_id, {FIXED_SCORE_SQL} AS p FROM embeddings)""")
def score_fixed_logistic(spark: SparkSession, root: str) -> DataFrame:
    scored = vectors(spark, root).select("id", fixed_score().alias("p"))
    return scored.select("id", F.round("p", 6).alias("probability"),
                         (F.col("p") >= 0.5).cast("double").alias("prediction"))


def _matrix_datasets(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    turns = read_table(spark, root, "conversations").select(
        (F.col("conv_id") * 100_000 + F.col("turn")).alias("id"), F.col("text").alias("comment"),
        (F.col("role") == "user").cast("float").alias("label"))
    return {"documents": sentence_corpus(labelled(spark, root)), "conversations": sentence_corpus(turns)}


@query("experiment_matrix", """
  SELECT dataset, feature_set, model, CASE model WHEN 'logistic' THEN 9 WHEN 'mlp' THEN 0 ELSE 6 END AS n_tried, 5 AS n_report_rows,
         metric, true AS in_range, true AS errors_agree
  FROM (VALUES ('documents'), ('conversations')) d(dataset),
       (VALUES ('tfidf'), ('word2vec'), ('pretrained_words'), ('encoder_tokens'), ('encoder_sentence')) f(feature_set),
       (VALUES ('logistic'), ('forest'), ('svc'), ('mlp')) m(model),
       (VALUES ('accuracy'), ('f1_macro'), ('f1_weighted'), ('auroc'), ('aupr'), ('mcc')) k(metric)""")
def experiment_matrix(spark: SparkSession, root: str) -> DataFrame:
    """Every run of the ledger with its metrics; the rows it got wrong agree with its accuracy."""
    ledger = Ledger(spark, scratch_dir(spark, "ledger"))
    for name, corpus in _matrix_datasets(spark, root).items():
        corpus = materialize(corpus, "matrix-corpus")
        words = scratch_dir(spark, "matrix-words")
        materialize(_word_vectors(corpus.select(tx.clean_tokens("comment").alias("tokens")), MATRIX_WORD_DIM), "words", words)
        options = {"pretrained_words": {"path": words}}
        run_matrix(name, corpus, {family: options.get(family, {}) for family in MATRIX_FAMILIES}, ledger=ledger)
    runs = ledger.runs()
    wrong = spark.read.schema("label double, prediction double").option("basePath", ledger.folder("predictions", "")).parquet(
        ledger.folder("predictions", "*")).select(F.regexp_extract(F.input_file_name(), "predictions/([0-9a-f]+)/", 1).alias("key"),
                                                  (F.col("label") == F.col("prediction")).cast("double").alias("hit"))
    share = wrong.groupBy("key").agg(F.avg("hit").alias("share"))
    accuracy = F.expr("element_at(filter(metrics, m -> m.metric = 'accuracy'), 1).value")
    return runs.join(share, "key").select(
        "dataset", "feature_set", "model", F.size("tried").alias("n_tried"), F.size("report").alias("n_report_rows"),
        (F.abs(accuracy - F.col("share")) < 1e-9).alias("errors_agree"), F.inline("metrics")).select(
        "dataset", "feature_set", "model", "n_tried", "n_report_rows", "metric",
        F.coalesce(F.col("value").between(-1, 1), F.lit(True)).alias("in_range"), "errors_agree")


# --- evaluation -----------------------------------------------------------------------------------

_P = f"({FIXED_PREDICTIONS_SQL}) p"


def _label_double(df: DataFrame) -> DataFrame:
    return df.withColumn("label", F.col("label").cast("double"))


@query("confusion_matrix", f"SELECT label, prediction, count(*) AS n FROM {_P} GROUP BY ALL")
def confusion_matrix(spark: SparkSession, root: str) -> DataFrame:
    return _label_double(ev.confusion_matrix(fixed_predictions(spark, root)))


@query("classification_report", f"""
  WITH c AS (SELECT c.class AS cls, count(*) FILTER (label = c.class) AS support,
                    count(*) FILTER (prediction = c.class) AS predicted,
                    count(*) FILTER (label = c.class AND prediction = c.class) AS tp
             FROM {_P}, (SELECT 0.0::DOUBLE AS class UNION ALL SELECT 1.0) c GROUP BY c.class),
  m AS (SELECT cls, support, tp, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS pr,
               CASE WHEN support = 0 THEN 0 ELSE tp / support END AS rc,
               CASE WHEN predicted + support = 0 THEN 0 ELSE 2 * tp / (predicted + support) END AS f
        FROM c)
  SELECT printf('%.1f', cls) AS class, round(pr, 6) AS precision, round(rc, 6) AS recall,
         round(f, 6) AS f1, support FROM m
  UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6),
                   round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m
  UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(rc), 6), round(avg(f), 6),
                   CAST(sum(support) AS BIGINT) FROM m
  UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 6),
                   round(sum(rc * support) / sum(support), 6),
                   round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m""")
def classification_report(spark: SparkSession, root: str) -> DataFrame:
    report = ev.classification_report(fixed_predictions(spark, root))
    return report.select("class", *[F.round(m, 6).alias(m) for m in ("precision", "recall", "f1")],
                         "support")


@query("auroc", f"""
  WITH r AS (SELECT label, rank() OVER (ORDER BY score)
                    + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rk FROM {_P}),
  c AS (SELECT sum(label) AS p, count(*) - sum(label) AS n FROM r)
  SELECT round(((SELECT sum(rk) FROM r WHERE label = 1) - p * (p + 1) / 2) / (p * n), 6) AS auroc
  FROM c""")
def auroc(spark: SparkSession, root: str) -> DataFrame:
    both = ev.ranking_metrics(fixed_predictions(spark, root))
    return both.select(F.round("auroc", 6).alias("auroc"))


@query("aupr", f"""
  WITH d AS (SELECT score, sum(label) AS pos, count(*) AS n FROM {_P} GROUP BY score),
  c AS (SELECT score, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS k, sum(pos) OVER () AS p
        FROM d WINDOW w AS (ORDER BY score DESC)),
  v AS (SELECT score, pos, p, tp / k AS pr FROM c),
  l AS (SELECT pos, p, pr, coalesce(lag(pr) OVER (ORDER BY score DESC), pr) AS before FROM v)
  SELECT round(sum(pos / p * (pr + before) / 2), 6) AS aupr FROM l""")
def aupr(spark: SparkSession, root: str) -> DataFrame:
    both = ev.ranking_metrics(fixed_predictions(spark, root))
    return both.select(F.round("aupr", 6).alias("aupr"))


@query("mcc", f"SELECT round(coalesce(corr(label, prediction), 0), 6) AS mcc FROM {_P}")
def mcc(spark: SparkSession, root: str) -> DataFrame:
    return ev.mcc(fixed_predictions(spark, root)).select(F.round("mcc", 6).alias("mcc"))


@query("error_sample", f"""
  SELECT id, label, prediction FROM {_P} WHERE prediction <> label ORDER BY id LIMIT 100""")
def error_sample(spark: SparkSession, root: str) -> DataFrame:
    errors = rel.misclassified(fixed_predictions(spark, root), limit=100)
    return _label_double(errors.select("id", "label", "prediction"))


@query("leaderboard", """
  WITH m AS (SELECT lang AS dataset, source AS model, avg(n_chars) AS mean_chars,
                    CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY lang, source),
  l AS (SELECT dataset, 'documents' AS feature_set, model, 'mean_chars' AS metric,
               round(mean_chars, 6) AS value FROM m
        UNION ALL SELECT dataset, 'documents', model, 'rows', n FROM m)
  SELECT *, CAST(row_number() OVER (PARTITION BY dataset, metric
            ORDER BY value DESC, feature_set, model) AS INTEGER) AS rank FROM l""")
def leaderboard(spark: SparkSession, root: str) -> DataFrame:
    per_source = documents(spark, root).groupBy("lang", "source").agg(
        F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.count("*").cast("double").alias("rows"))
    metrics = per_source.select(
        F.col("lang").alias("dataset"), F.lit("documents").alias("feature_set"),
        F.col("source").alias("model"),
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
                           for m in ("mean_chars", "rows")])))
    return ev.leaderboard(metrics)
