"""Compare registered queries with their SQL in DuckDB.

``python tests/oracle.py [--sf DIR] [name ...]`` checks from the command line.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

# Spark type name -> DuckDB type name
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
         "boolean": "BOOLEAN"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple("" if v is None else repr(v) for v in row)


def compare(df, sql: str, con) -> list[str]:
    """Differences between a DataFrame and a SQL result; empty if equal."""
    cols = sorted(df.columns)
    described = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    if sorted(described) != cols:
        return [f"columns {cols} != {sorted(described)}"]
    out = []
    for name, spark_type in df.dtypes:
        if TYPES.get(spark_type) != described[name]:
            out.append(f"type of {name}: {spark_type} != {described[name]}")
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=_key)
    select = ", ".join(f'"{c}"' for c in cols)
    want = sorted(con.execute(f"SELECT {select} FROM ({sql}) q").fetchall(), key=_key)
    if len(got) != len(want):
        out.append(f"{len(got)} rows != {len(want)} rows")
    bad = [(g, w) for g, w in zip(got, want) if _key(g) != _key(w)]
    if bad:
        out.append(f"{len(bad)} rows differ, first: {str(bad[0][0])[:300]} != {str(bad[0][1])[:300]}")
    return out


def main(argv: list[str]) -> int:
    sf = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    import __spark_entry__ as e
    from labelloom.session import build_session
    spark = build_session("oracle", "local[8]", {
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracle = e.queries(), e.oracle_sql()
    failed = 0
    for name in argv or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf)
            diffs = compare(df, oracle[name], con) if name in oracle else \
                ([] if df.count() > 0 else ["no rows"])
        except Exception as error:  # report and go on with the next query
            diffs = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(diffs)
        kind = "sql " if name in oracle else "rows"
        print(f"{'FAIL' if diffs else 'ok  '} {kind} {time.time() - start:6.1f}s {name}", flush=True)
        for d in diffs:
            print("       ", d, flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
