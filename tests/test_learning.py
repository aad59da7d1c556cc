"""Weights, feature families, classifiers, persistence."""

from __future__ import annotations

import math
import sys
import types

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from labelloom.functions.encoders import hashed_ngrams, pooled_encoder
from labelloom.operators import classify, weights
from labelloom.operators.evaluate import positive_score, ranking_metrics
from labelloom.operators.feature_sets import feature_set
from labelloom.operators.sampling import train_test_split
from labelloom.operators.stages import PooledTokenEncoder
from labelloom.plans import learning
from labelloom.plans.experiment import run_matrix
from labelloom.plans.inputs import labelled, vectors
from labelloom.plans.prepare import feature_tables, fit_once, sentence_corpus, token_corpus
from labelloom.plans.registry import ORACLE
from labelloom.sources.models import load_pipeline, save_model


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, ["a", "b", "a"]), (2, ["a"]), (3, [])]
    return spark.createDataFrame(rows, "id long, tokens array<string>")


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return labelled(spark, sf).cache()


@pytest.fixture(scope="module")
def planted(spark):
    """Texts whose label says whether they hold a given word."""
    words = F.transform(F.sequence(F.lit(1), F.lit(12)),
                        lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(40))))
    hit = F.pmod(F.xxhash64("id", F.lit(99)), F.lit(2)) == 1
    text = F.concat_ws(" ", words, F.when(hit, "signal"))
    return spark.range(400).select("id", text.alias("comment"), hit.cast("float").alias("label")).cache()


def test_tfidf(docs):
    got = {(r.id, r.term): (r.tf, r.weight) for r in weights.tfidf(docs).collect()}
    assert got[(1, "a")] == (2, pytest.approx(2 * math.log(4 / 3)))
    assert got[(1, "b")] == (1, pytest.approx(math.log(4 / 2)))
    assert set(got) == {(1, "a"), (1, "b"), (2, "a")}


def test_tfidf_with_a_term_everywhere(spark):
    df = spark.range(2000).select("id", F.array(F.lit("hot"), F.col("id").cast("string")).alias("tokens"))
    out = weights.tfidf(df)
    assert out.count() == 4000
    assert out.filter("term = 'hot'").agg(F.max("weight")).first()[0] == 0


def test_standardize(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([2.0, 5.0],), ([4.0, 5.0],)], "features array<double>")
    got = sorted(tuple(r.features) for r in weights.standardize(df).collect())
    assert [g[0] for g in got] == pytest.approx([-0.8729, -0.2182, 1.0911], abs=1e-4)
    assert [g[1] for g in got] == [0, 0, 0]


def test_mean_pool(spark):
    df = spark.createDataFrame([(1, [1.0, 3.0], 1), (1, [3.0, 5.0], 3)], "id int, vector array<double>, w int")
    assert weights.mean_pool(df).first().features == [2.0, 4.0]
    assert weights.mean_pool(df, weight="w").first().features == [2.5, 4.5]


def test_pooled_word_vectors(spark, docs):
    table = spark.createDataFrame([("a", [1.0, 0.0]), ("z", [9.0, 9.0])], "word string, vector array<float>")
    skip = {r.id: r.features for r in weights.pooled_word_vectors(docs, table).collect()}
    assert skip == {1: [1.0, 0.0], 2: [1.0, 0.0]}
    zero = {r.id: r.features for r in
            weights.pooled_word_vectors(docs, table, unknown="zero", dim=2).collect()}
    assert zero == {1: [pytest.approx(2 / 3), 0.0], 2: [1.0, 0.0]}
    with pytest.raises(ValueError):
        weights.pooled_word_vectors(docs, table, unknown="guess")


def test_pretrained_words_clean_texts_once(spark, sf, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def split(text):
        seen.add(1)
        return text.split()
    rows = spark.createDataFrame([(i, f"some words here {i}") for i in range(20)], "id long, text string")
    monkeypatch.setattr(learning, "_tokens", lambda *_: rows.select("id", F.udf(split, "array<string>")("text").alias("tokens")))
    assert learning.features_pretrained_words(spark, sf).select("id").distinct().count() == 20
    assert seen.value == 20


def test_pooled_token_encoder(spark):
    """Means of the encoded tokens by hand, over many batches; no vector is shuffled."""
    rows = [(i, [None if j == 3 else f"w{i * j % 97}" for j in range(i % 9)]) for i in range(300)] + [(8, ["w1", "v"]), (None, ["x"]), (400, None)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    stage = PooledTokenEncoder(inputCol="tokens", outputCol="features", dim=16, batchSize=7)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        out = stage.transform(df.repartition(3)).select("id", vector_to_array("features").alias("f"))
        assert "CoGroup" not in out._jdf.queryExecution().sparkPlan().toString()
        got = sorted((r.id, tuple(r.f)) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    encode, want = hashed_ngrams(16)(), []
    for i, _ in rows:
        terms = [t for k, r in rows if k is not None and k == i for t in r or [] if t is not None]
        if terms:
            want.append((i, tuple(encode(np.array(terms, dtype=object)).astype(float).mean(axis=0))))
    assert [i for i, _ in got] == [i for i, _ in sorted(want)]
    assert np.allclose([f for _, f in got], [f for _, f in sorted(want)], atol=1e-6)


def test_kept_words_are_encoded_once():
    calls = []

    def factory(dim):
        return lambda: lambda words: calls.extend(words) or np.array([[len(w), 1.0] for w in words], dtype=np.float32)
    sys.modules["_planted"] = types.SimpleNamespace(factory=factory)
    run = pooled_encoder("_planted:factory", 2, 2, kept=1).func
    batches = [pa.array([["aa", "b", "aa"], []]), pa.array([["aa", "ccc"]])]
    out = [b.to_pylist() for b in run(iter(batches))]
    assert out == [[[pytest.approx(5 / 3), 1.0], [0.0, 0.0]], [[2.5, 1.0]]]
    assert sorted(calls) == ["aa", "b", "ccc"]


def test_assemble_skips_invalid(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([None, 1.0],), ([float("nan"), 1.0],)], "features array<double>")
    assert [r.features for r in weights.assemble(df).collect()] == [Vectors.dense(1.0, 2.0)]


def test_pca_axes_and_variance(spark, sf):
    df = vectors(spark, sf).select("id", array_to_vector("features").alias("v"))
    model = PCA(k=5, inputCol="v", outputCol="p").fit(df)
    axes = model.pc.toArray()
    assert np.allclose(axes.T @ axes, np.eye(5), atol=1e-8)
    x = np.array([r.v.toArray() for r in df.collect()])
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.allclose(model.explainedVariance.toArray(), values[:5] / values.sum(), atol=1e-8)


def test_centring_after_projection_is_exact(spark, corpus):
    """The sparse pipeline equals scaling with the mean before PCA."""
    model = feature_set("tfidf", num_features=64, k=4).fit(corpus)
    ready = model.transform(corpus)
    dense = StandardScaler(inputCol="tfidf", outputCol="s", withMean=True, withStd=True).fit(ready)
    both = PCA(k=4, inputCol="s", outputCol="p").fit(dense.transform(ready)) \
        .transform(dense.transform(ready)).select("features", "p").collect()
    ours = np.array([r.features.toArray() for r in both])
    theirs = np.array([r.p.toArray() for r in both])
    signs = np.sign((ours * theirs).sum(axis=0))
    assert np.allclose(ours, theirs * signs, atol=1e-4)


OPTIONS = {
    "tfidf": {"num_features": 64, "k": 4}, "hashed_tfidf": {"num_features": 64},
    "word2vec": {"size": 8, "iterations": 1, "min_count": 1, "partitions": 1},
    "encoder_tokens": {"dim": 16}, "encoder_sentence": {"dim": 16},
}


@pytest.mark.parametrize("name", OPTIONS)
def test_saved_features_equal(spark, corpus, tmp_path, name):
    model = fit_once(feature_set(name, **OPTIONS[name]), corpus)
    back = load_pipeline(save_model(model, str(tmp_path / "m")))
    before = {r.id: r.features for r in model.transform(corpus).select("id", "features").collect()}
    after = {r.id: r.features for r in back.transform(corpus).select("id", "features").collect()}
    assert before == after and len(before) == corpus.count()


def test_fit_once_equals_fit(corpus):
    pipeline = feature_set("hashed_tfidf", num_features=128)
    a = pipeline.fit(corpus).transform(corpus).select("id", "features").collect()
    b = fit_once(pipeline, corpus).transform(corpus).select("id", "features").collect()
    assert {r.id: r.features for r in a} == {r.id: r.features for r in b}


def test_pretrained_words_stage(spark, corpus, tmp_path):
    path = str(tmp_path / "words")
    spark.createDataFrame([("the", [1.0, 1.0]), ("zz", [1.0, 1.0])], "word string, vector array<float>") \
        .write.parquet(path)
    out = feature_set("pretrained_words", path=path).fit(corpus).transform(corpus)
    assert out.count() == 0  # "the" is a stop word
    df = spark.createDataFrame([(1, "zz ZZ! other", 1.0)], "id long, comment string, label double")
    row = feature_set("pretrained_words", path=path).fit(df).transform(df).first()
    assert row.features == Vectors.dense(1.0, 1.0)


def test_encoder_reads_whole_texts(spark):
    df = spark.createDataFrame([(1, "a" * 5000 + " x", 1.0), (2, "a" * 5000 + " y", 1.0), (3, "", 1.0)],
                               "id long, comment string, label double")
    rows = feature_set("encoder_sentence", dim=32).fit(df).transform(df).orderBy("id").collect()
    assert rows[0].features != rows[1].features
    assert rows[2].features.toArray().sum() == 0


def nan_for_bad(dim):
    """An encoder whose vector of a text with "bad" in it is not a number."""
    def make():
        def predict(texts):
            return np.array([[np.nan if "bad" in t else 1.0] * dim for t in texts], dtype=np.float32)
        return predict
    return make


def test_families_leave_out_invalid_features(spark, tmp_path):
    df = spark.createDataFrame([(1, "good text"), (2, "bad text"), (3, "fine")], "id long, comment string")
    for name in ("encoder_sentence", "encoder_tokens"):
        model = feature_set(name, dim=3, factory="test_learning:nan_for_bad").fit(df)
        model.write().overwrite().save(str(tmp_path / name))
        for m in (model, PipelineModel.load(str(tmp_path / name))):
            assert sorted(r.id for r in m.transform(df).select("id", "features").collect()) == [1, 3]


def test_unknown_names():
    with pytest.raises(ValueError):
        feature_set("nope")
    with pytest.raises(ValueError):
        classify.make_classifier("nope")


def test_mlp_width_is_checked(spark, sf):
    train = vectors(spark, sf).withColumn("features", array_to_vector("features"))
    with pytest.raises(ValueError, match="width 64"):
        classify.fit_classifier("mlp", train, layers=[10, 4, 2], maxIter=1)
    with pytest.raises(ValueError, match="no rows"):
        classify.feature_width(train.filter("false"))


@pytest.mark.parametrize("name,points", [("logistic", 9), ("forest", 6), ("svc", 6)])
def test_default_grids(spark, name, points):
    estimator = classify.make_classifier(name)
    assert len(classify.param_grid(estimator, classify.CLASSIFIERS[name][2])) == points


@pytest.mark.parametrize("name", ["logistic", "forest", "svc", "mlp"])
def test_planted_signal_is_learned(planted, name):
    model, train, test = feature_tables(planted, "hashed_tfidf", num_features=256)
    assert isinstance(model, PipelineModel)
    options = {"maxIter": 60} if name == "mlp" else {"regParam": 0.01} if name != "forest" else {}
    fitted = classify.fit_classifier(name, train, tune=False, **options)
    scored = classify.score(fitted, test).select("label", positive_score().alias("score"))
    assert ranking_metrics(scored).first().auroc > 0.9


def test_cross_validation_ranks_grid_points(planted):
    train, _ = train_test_split(planted)
    train = fit_once(feature_set("hashed_tfidf", num_features=128), train).transform(train)
    model = classify.cross_validate("logistic", train, {"regParam": [0.01, 100.0]}, folds=2,
                                    maxIter=20)
    scores = classify.cv_scores(model)
    assert [r[2] for r in scores] == [1, 2] and scores[0][0] == "regParam=0.01"
    assert model.bestModel.getRegParam() == 0.01
    assert model.bestModel.coefficients.numNonzeros() > 0


def test_matrix_has_a_row_per_run(planted):
    board = run_matrix("planted", planted, {"hashed_tfidf": {"num_features": 64}},
                       models=["logistic", "forest"], tune=False,
                       tuning={"logistic": {"regParam": 0.01}}).collect()
    assert len(board) == 2 * 6
    assert {(r.model, r["rank"]) for r in board if r.metric == "auroc"} in (
        {("logistic", 1), ("forest", 2)}, {("logistic", 2), ("forest", 1)})


def test_fit_on_all_is_explicit(planted):
    with pytest.raises(ValueError):
        feature_tables(planted, "hashed_tfidf", fit_on="test")


def test_corpora(spark, sf, corpus):
    tokens = token_corpus(corpus)
    assert tokens.groupBy("tokens").count().filter("count > 1").count() == 0
    balanced = sentence_corpus(labelled(spark, sf, "toxic"), balance=True)
    assert len({r["count"] for r in balanced.groupBy("label").count().collect()}) <= 1


def test_vectors_roundtrip_float32(spark):
    df = spark.createDataFrame([([0.1, 0.2],)], "f array<float>")
    back = df.select(vector_to_array(array_to_vector("f"), "float32").alias("g"), "f").first()
    assert back.f == back.g


def test_features_are_worked_out_once(spark, tmp_path):
    """The check of the vectors isn't a filter on the scan, where the text would be cleaned once more."""
    spark.createDataFrame([(1, "a good day"), (2, "a bad night")], "id long, comment string").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    out = feature_set("hashed_tfidf", num_features=16).fit(rows).transform(rows).select("id", "features")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert out.count() == 2


def test_vectors_are_compared_by_digests(spark):
    """Equal values are equal, whatever their sign of zero; each pair of rows of an id counts."""
    def vectors(*rows):
        return spark.createDataFrame([(i, Vectors.dense(v)) for i, v in rows], ["id", "v"])

    before = vectors((1, [0.0, 2.0]), (2, [1.0, 2.0]), (3, [float("nan")]), (4, [1.0]), (4, [2.0]), (5, [1.0]))
    after = vectors((1, [-0.0, 2.0]), (2, [1.0, 2.5]), (3, [float("nan")]), (4, [1.0]), (4, [2.0]))
    out = learning._all_equal(before, after, "v")
    assert tuple(out.first()) == (7, 4)
    joined = out._jdf.queryExecution().optimizedPlan().toString().split("Join")[1]
    assert joined.count("xxhash64(1, unwrap_udt") == 2


def test_the_matrix_query_is_whole(spark, sf, monkeypatch):
    """All five families on both tables, every model with a grid tuned over it, and the SQL asks for that."""
    calls = []

    def stopped(name, corpus, feature_sets, models=tuple(classify.CLASSIFIERS), tune=True, **options):
        calls.append((name, set(feature_sets), set(models), tune, feature_sets["pretrained_words"]["path"]))

    monkeypatch.setattr(learning, "run_matrix", stopped)
    monkeypatch.setattr(learning.Ledger, "runs", lambda self: (_ for _ in ()).throw(InterruptedError))
    with pytest.raises(InterruptedError):
        learning.experiment_matrix(spark, sf)
    families = {"tfidf", "word2vec", "pretrained_words", "encoder_tokens", "encoder_sentence"}
    assert [c[:4] for c in calls] == [(d, families, {"logistic", "forest", "svc", "mlp"}, True) for d in ("documents", "conversations")]
    for *_, path in calls:
        assert {len(r.vector) for r in spark.read.parquet(path).collect()} == {300}
    tried = duckdb.sql(f"SELECT model, n_tried, count(*) FROM ({ORACLE['experiment_matrix']}) GROUP BY ALL").fetchall()
    assert set(tried) == {("logistic", 9, 60), ("forest", 6, 60), ("svc", 6, 60), ("mlp", 0, 60)}


def test_stand_in_words_of_any_width(spark):
    """Wider vectors begin with the narrow ones, and no block repeats another."""
    tokens = spark.createDataFrame([(["word", "none", "by"],), (["word", None],)], "tokens array<string>")
    narrow = {r.word: r.vector for r in learning._word_vectors(tokens).collect()}
    wide = {r.word: r.vector for r in learning._word_vectors(tokens, 20).collect()}
    assert set(narrow) == set(wide) == {"word", "none"} and {len(v) for v in wide.values()} == {20}
    assert all(wide[w][:8] == narrow[w] and len(set(wide[w])) == 20 for w in wide)
