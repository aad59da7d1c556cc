"""Golden cases of text, token and cast functions."""

from __future__ import annotations

import pytest

from labelloom.functions import numeric as nm
from labelloom.functions import text as tx
from labelloom.operators import relational as rel
from labelloom.operators import tokens as tok


def one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"c {dtype}").select(expr.alias("o")).first()["o"]


@pytest.mark.parametrize("raw,ascii_,uni", [
    ("  Café_1!  x ", "caf_1 x", "café_1 x"),
    ("", "", ""),
    ("!!!", "", ""),
    ("a\tb\nc   d", "a\tb\nc d", "a\tb\nc d"),
    ("Don't STOP", "dont stop", "dont stop"),
    ("straße — ñ", "strae", "straße ñ"),
])
def test_clean_text(spark, raw, ascii_, uni):
    assert one(spark, tx.clean_text("c"), raw) == ascii_
    assert one(spark, tx.clean_text("c", unicode=True), raw) == uni


def test_clean_text_null(spark):
    assert one(spark, tx.clean_text("c"), None) is None


def test_tokenize(spark):
    assert one(spark, tx.tokenize("c"), "  a  b\n\nc ") == ["a", "b", "c"]
    assert one(spark, tx.tokenize("c"), " ") == []


def test_normalize_drops_empty(spark):
    assert one(spark, tx.normalize_tokens("c"), ["A!", "--", "b_2"], "array<string>") == ["a", "b_2"]


def test_stopwords_keep_order_and_repeats(spark):
    got = one(spark, tx.remove_stopwords("c"), ["The", "cat", "and", "cat", "sat"], "array<string>")
    assert got == ["cat", "cat", "sat"]
    assert one(spark, tx.remove_stopwords("c", []), ["the"], "array<string>") == ["the"]


def test_fused_chain_equals_steps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = tx.remove_stopwords(tx.normalize_tokens(tx.tokenize("text")))
    assert docs.filter(~steps.eqNullSafe(tx.clean_tokens("text"))).count() == 0
    assert docs.filter(~tx.normalize_tokens(tx.tokenize("text"))
                       .eqNullSafe(tx.normalized_tokens("text"))).count() == 0


def test_nonempty_tokens(spark):
    rows = [(1, ["a"]), (2, []), (3, [""]), (4, [None]), (5, None), (6, ["a", ""])]
    df = spark.createDataFrame(rows, "id int, tokens array<string>")
    assert sorted(r.id for r in rel.nonempty_tokens(df).collect()) == [1, 6]


def test_bad_labels(spark):
    df = spark.createDataFrame([(1, "0"), (2, "1"), (3, "oops"), (4, None)], "id int, label string")
    typed = df.withColumn("label", nm.label_as_float("label"))
    assert sorted(r.id for r in typed.na.drop(subset=["label"]).collect()) == [1, 2]
    assert [r.id for r in rel.with_label(df, 0).collect()] == [1]


def test_array_access_past_end(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "f array<double>")
    assert tuple(df.select(*nm.element_columns("f", 3)).first()) == (1.0, 2.0, None)


def test_finite(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, None)],
                               "id int, f array<double>")
    assert [r.id for r in df.filter(nm.finite("f")).collect()] == [1]


def test_mean_of_vectors(spark):
    df = spark.createDataFrame([(1, [[1.0, 3.0], [3.0, 5.0]]), (2, [])], "id int, v array<array<double>>")
    got = {r.id: r.m for r in df.select("id", nm.mean_of_vectors("v", 2).alias("m")).collect()}
    assert got == {1: [2.0, 4.0], 2: None}


@pytest.fixture(scope="module")
def token_rows(spark):
    rows = [(1, ["running", "dogs", "ran", "The"]), (2, []), (3, None), (4, ["dogs", "dogs", "x"])]
    return spark.createDataFrame(rows, "id long, tokens array<string>")


def test_lemmatize(spark, token_rows):
    table = spark.createDataFrame([("running", "run"), ("dogs", "dog"), ("dogs", "doggo"), (None, "n")],
                                  "form string, lemma string")
    got = {r.id: r.tokens for r in tok.lemmatize(token_rows, table).collect()}
    assert got == {1: ["run", "dog", "ran", "The"], 2: [], 3: None, 4: ["dog", "dog", "x"]}


def test_null_and_repeated_ids_keep_their_tokens(spark):
    rows = [(None, ["dogs", "a"]), (7, ["dogs"]), (7, ["cats", "dogs"]), (7, ["dogs"]), (8, ["dogs", None])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    table = spark.createDataFrame([("dogs", "dog")], "form string, lemma string")
    got = sorted((str(r.id), r.tokens) for r in tok.lemmatize(df, table).collect())
    assert got[:3] == [("7", ["cats", "dog"]), ("7", ["dog"]), ("7", ["dog"])]
    assert ("None", ["dog", "a"]) in got and ("8", ["dog", None]) in got
    left = sorted((str(r.id), r.tokens) for r in tok.remove_stopword_table(df, spark.createDataFrame([("A",)], "w string")).collect())
    assert ("None", ["dogs"]) in left and len(left) == 5


def test_stopword_table(spark, token_rows):
    table = spark.createDataFrame([("the",), ("DOGS",), (None,)], "word string")
    got = {r.id: r.tokens for r in
           tok.remove_stopword_table(token_rows, table).collect()}
    assert got == {1: ["running", "ran"], 2: [], 3: None, 4: ["x"]}
