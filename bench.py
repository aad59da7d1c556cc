"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the cores.  Every query runs to completion into the no-op sink.
``python bench.py name ...`` times only the named queries.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from labelloom.plans import catalog  # noqa: E402
from labelloom.plans.benchmarks import BENCHMARKS  # noqa: E402
from labelloom.session import build_session  # noqa: E402


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")})
    spark.sparkContext.setLogLevel("ERROR")
    known = {**catalog.QUERIES, **BENCHMARKS}
    known["flagship"](spark, sf_dir).collect()  # start-up and warm-up are not measured
    times: dict[str, float] = {}
    for name in names or list(dict.fromkeys([*HEADLINE, *BENCHMARKS])):
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{times[name]:8.2f}s {name}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus)}))


HEADLINE = [
    "flagship", "csv_scan", "request_parse", "text_clean", "clean_tokens", "lemmatize",
    "dedupe_labelled", "conflict_filter", "conflict_anti_join", "conflict_keys",
    "balance_classes", "sample_fraction", "train_test_split", "skip_scored", "term_frequency",
    "tfidf", "standardize", "mean_pool", "features_pretrained_words", "features_encoder_tokens",
    "features_encoder_sentence", "auroc", "classification_report", "debounce_sessions",
    "stream_dedupe", "stream_score",
]

if __name__ == "__main__":
    main(sys.argv[1:])
