"""Run registered queries on Spark and their SQL on DuckDB, and compare the rows.

    python tests/oracle_check.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TESTDATA = Path("/root/testdata")


def make_spark(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shelfwise-check")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: Path):
    import duckdb

    con = duckdb.connect()
    for f in sorted(sf_dir.glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    # 0.0 and -0.0 are the same number
    clean = [
        tuple(0.0 if isinstance(r[i], float) and r[i] == 0 else r[i] for i in order) for r in rows
    ]
    return sorted(clean, key=repr), [columns[i] for i in order]


def compare(spark, con, name, queries, sqls, sf_dir):
    df = queries[name](spark, str(sf_dir))
    got, gcols = _rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in sqls:
        return len(got), None
    cur = con.execute(sqls[name])
    want, wcols = _rows([d[0] for d in cur.description], cur.fetchall())
    if gcols != wcols:
        return len(got), f"columns {sorted(set(gcols) ^ set(wcols))}"
    if len(got) != len(want):
        return len(got), f"rows {len(got)} vs {len(want)}"
    if list(map(repr, got)) != list(map(repr, want)):
        gs, ws = set(map(repr, got)), set(map(repr, want))
        a, b = sorted(gs - ws)[:2], sorted(ws - gs)[:2]
        return len(got), f"{len(gs - ws)} rows differ\n  cols {gcols}\n  spark {a}\n  sql   {b}"
    return len(got), ""


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as entry

    queries, sqls = entry.queries(), entry.oracle_sql()
    sf_dir = TESTDATA / f"sf{args.sf}"
    spark, con = make_spark(), duck(sf_dir)
    bad = 0
    for name in queries:
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        t0 = time.time()
        try:
            n, problem = compare(spark, con, name, queries, sqls, sf_dir)
        except Exception as e:  # report and go on
            n, problem = -1, f"{type(e).__name__}: {str(e)[:1500]}"
        state = "rows-only" if problem is None else ("ok" if problem == "" else "FAIL")
        bad += state == "FAIL"
        print(f"{state:9} {name:42} {n:8} {time.time() - t0:6.1f}s {problem or ''}", flush=True)
    print("failed:", bad)
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
