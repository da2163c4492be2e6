"""Run queries and their oracle side by side: ``python -m tests.compare SF_DIR [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def _bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


def compare(df, con, statement: str) -> tuple[bool, str]:
    result = con.execute(statement)
    columns = [d[0] for d in result.description]
    want = _bag(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    got = _bag(df.columns, [tuple(r) for r in df.collect()])
    if got == want:
        return True, f"{sum(got.values())} rows"
    extra, lacking = got - want, want - got
    sample = lambda c: str(next(iter(c), None))[:700]
    return False, (f"rows {sum(got.values())} vs {sum(want.values())}; only here {sum(extra.values())}: {sample(extra)}"
                   f" | only oracle {sum(lacking.values())}: {sample(lacking)}")


def main() -> None:
    from corpusloom.session import build_session
    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    oracle, bad = entry.oracle_sql(), []
    for name, make in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = make(spark, sf_dir)
            ok, note = compare(df, con, oracle[name]) if name in oracle else (True, f"{df.count()} rows, no oracle")
        except Exception as error:
            ok, note = False, f"{type(error).__name__}: {str(error)[:900]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
        bad += [] if ok else [name]
    print("failed:", bad)


if __name__ == "__main__":
    main()
