"""Debouncing by the clock: arrivals are replayed with real pauses."""

from __future__ import annotations

import json
import time

from pyspark.sql import functions as F

from labelloom.sources.requests import accepted_comments, parse_requests
from labelloom.streaming.arrivals import debounced_requests

ROWS = "page string, id string, comment string"


def test_quiet_time_flushes_one_batch(spark, tmp_path):
    inbox = str(tmp_path / "in")
    spark.createDataFrame([], ROWS).write.parquet(inbox)
    stream = debounced_requests(spark.readStream.schema(ROWS).parquet(inbox), quiet_ms=4000, most=50)
    query = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start())

    def arrive(rows):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(inbox)
        wait(lambda: any(p["numInputRows"] == len(rows) for p in query.recentProgress[-3:]))

    def wait(done, seconds=60):
        end = time.time() + seconds
        while not done() and time.time() < end:
            time.sleep(0.1)

    def sent():
        out = spark.read.schema("page string, body string, n long").parquet(str(tmp_path / "out"))
        return sorted((r.page, [(i["id"], i["comment"]) for i in json.loads(r.body)["textComments"]], r.n) for r in out.collect())

    try:
        arrive([("p", "a", 'one "quoted"'), ("p", "b", "two"), ("p", "a", "again"), ("p", None, "nobody"), ("q", "x", None)])
        arrive([("p", "c", "drei ü")])
        wait(lambda: sent())
        first = ("p", [("a", 'one "quoted"'), ("b", "two"), ("c", "drei ü")], 3)
        assert sent() == [first]
        arrive([("p", "d", "later")])
        wait(lambda: len(sent()) == 2)
        assert sent() == [first, ("p", [("d", "later")], 1)]
        arrive([("busy", str(i), "x") for i in range(120)])
        wait(lambda: len(sent()) == 5)
        assert [n for page, _, n in sent() if page == "busy"] in ([20, 50, 50], [50, 20, 50], [50, 50, 20])
    finally:
        query.stop()
    bodies = spark.read.schema("page string, body string, n long").parquet(str(tmp_path / "out"))
    parsed = accepted_comments(parse_requests(bodies))
    assert parsed.count() == 4 + 120 and parsed.where(F.col("comment").isNull()).count() == 0
