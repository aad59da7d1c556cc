"""CSV quoting, request parsing, storage helpers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from labelloom.session import materialize, scratch_dir
from labelloom.sources import requests as rq
from labelloom.sources import tables as tb
from labelloom.sources.schemas import COMMENTS_CSV, CORRUPT, TEXT_Y_CSV, _strings


def test_csv_quoting(spark, tmp_path):
    (tmp_path / "a.csv").write_text('label,comment,author\n0,"he said ""hi"", ok",a\n1,"line1\nline2",b\n0,,c\n')
    df = tb.read_csv(spark, str(tmp_path), _strings("label", "comment", "author"))
    got = sorted(((r.label, r.comment, r.author) for r in df.collect()), key=lambda r: r[2])
    assert got == [("0", 'he said "hi", ok', "a"), ("1", "line1\nline2", "b"), ("0", None, "c")]
    assert tb.typed_comments(df).na.drop(subset=["comment", "label"]).count() == 2


def test_csv_corrupt_record(spark, tmp_path):
    (tmp_path / "a.csv").write_text("text,Y\nfine,1\ntoo,many,fields\n")
    df = tb.read_csv(spark, str(tmp_path), TEXT_Y_CSV, keep_corrupt=True).cache()
    assert [r[CORRUPT] for r in df.filter(F.col(CORRUPT).isNotNull()).collect()] == ["too,many,fields"]
    df.unpersist()


def test_csv_several_paths_and_schema(spark, tmp_path):
    for n in ("train", "test"):
        (tmp_path / f"{n}.csv").write_text(f"text,Y\n{n},1\n")
    both = tb.read_csv(spark, [str(tmp_path / "train.csv"), str(tmp_path / "test.csv")], TEXT_Y_CSV)
    assert sorted(r.text for r in both.collect()) == ["test", "train"]
    assert len(COMMENTS_CSV) == 10


BODIES = [
    (1, json.dumps({"textComments": [{"id": "a", "comment": "x"}, {"id": "b", "comment": "y"}]})),
    (2, json.dumps({"textComments": {"id": "c", "comment": "z"}})),
    (3, json.dumps({"other": []})),
    (4, "{broken"),
    (5, None),
    (6, json.dumps({"textComments": "text"})),
    (7, json.dumps({"textComments": []})),
    (8, json.dumps([1, 2])),
    (9, json.dumps({"textComments": [{"id": 7, "comment": "n"}]})),
    (10, json.dumps({"textComments": [{"id": "d", "comment": "x"}, 5]})),
    (11, json.dumps({"textComments": [{"comment": "no id"}]})),
    (12, json.dumps({"textComments": None})),
    (13, json.dumps({"textComments": [{"id": "e", "comment": "x", "more": [1]}], "other": 1})),
]


def test_requests(spark):
    parsed = rq.parse_requests(spark.createDataFrame(BODIES, "n int, body string"))
    good = sorted((r.n, r.id, r.comment) for r in rq.accepted_comments(parsed, ("n",)).collect())
    assert good == [(1, "a", "x"), (1, "b", "y"), (2, "c", "z"), (9, "7", "n"),
                    (13, "e", "x")]
    bad = {r.n: r.reject_reason for r in rq.rejected_requests(parsed).collect()}
    assert bad == {3: "missing_textComments", 4: "not_json", 5: "not_json", 6: "bad_items",
                   8: "missing_textComments", 10: "bad_items", 11: "bad_items",
                   12: "bad_items"}


def test_response(spark):
    df = spark.createDataFrame([("t1", 1.0)], "id string, prediction double")
    assert json.loads(df.select(rq.response_json().alias("j")).first().j) == {"id": "t1", "prediction": 1.0}


def test_scratch_uses_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(spark, "x").startswith(base)
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")


def test_materialize_cuts_lineage(spark):
    df = materialize(spark.range(10).withColumn("v", F.rand()), "m")
    assert sorted(df.collect()) == sorted(df.collect())


@pytest.mark.parametrize("name", ["documents", "labels", "conversations", "embeddings", "events"])
def test_declared_schemas_match_the_files(spark, sf, name):
    inferred = spark.read.parquet(f"{sf}/{name}.parquet").schema
    declared = tb.read_table(spark, sf, name).schema
    assert [(f.name, f.dataType) for f in inferred] == [(f.name, f.dataType) for f in declared]


def test_scan_reads_two_columns(spark, sf):
    plan = tb.read_table(spark, sf, "documents").select("doc_id", "lang").filter("lang = 'en'") \
        ._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan
    assert "EqualTo(lang,en)" in plan


def test_item_without_comment_is_quarantined_alone(spark):
    bodies = ['{"textComments":[{"id":"a","comment":"YES!"},{"id":"b"}]}', '{"textComments":[{"id":"c","comment":null}]}',
              '{"textComments":[{"id":"d","comment":"no"}]}']
    parsed = rq.parse_requests(spark.createDataFrame([(b,) for b in bodies], "body string"))
    assert sorted(r.id for r in rq.accepted_comments(parsed).collect()) == ["a", "d"]
    assert [r.reject_reason for r in rq.rejected_requests(parsed).collect()] == [rq.NO_COMMENT] * 2


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_row_ids_depend_on_content_only(spark, parts):
    rows = [("a", "x"), ("a", "x"), ("a", None), (None, None), ("", "x"), ("a", "x")]
    df = spark.createDataFrame(rows, "comment string, label string")
    ids = [sorted(map(tuple, tb.with_row_id(d).collect()), key=str) for d in (df, df.repartition(parts))]
    assert ids[0] == ids[1] and len({r[0] for r in ids[0]}) == len(rows)
