"""Compare registered queries with their SQL in DuckDB.

    python tests/oracle.py [sf_dir] [name ...]
"""

import math
import os
import sys
import time
import traceback
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, bool) or v is None:
        return v
    return v


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(n for n in names), Counter(
        tuple((type(norm(r[i])).__name__, norm(r[i])) for i in order) for r in rows
    )


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, sum(got[1].values())
    rel = con.execute(sql)
    want = rows_of([d[0] for d in rel.description], rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", 0
    if got[1] != want[1]:
        extra, missing = got[1] - want[1], want[1] - got[1]
        return (
            f"rows differ: +{sum(extra.values())} -{sum(missing.values())} "
            f"spark only {list(extra)[:2]} sql only {list(missing)[:2]}"
        ), sum(got[1].values())
    return "", sum(got[1].values())


def main():
    from pyspark.sql import SparkSession

    from slotlake.session import configure
    from slotlake.showcase import all_queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (
        configure(SparkSession.builder.master("local[8]"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", "/tmp/slotlake-warehouse")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, (fn, sql) in all_queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.monotonic()
        try:
            problem, n = compare(spark, con, name, fn, sql, sf_dir)
        except Exception as exc:  # noqa: BLE001
            problem, n = f"{type(exc).__name__}: {str(exc)[:1500]}", 0
            if os.environ.get("TRACE"):
                traceback.print_exc()
        mark = "rows" if problem is None else ("ok" if problem == "" else "FAIL")
        bad += mark == "FAIL" or n == 0
        print(f"{mark:5} {name:28} {n:7} rows {time.monotonic() - start:6.1f}s {problem or ''}", flush=True)
    print("failed or empty:", bad)


if __name__ == "__main__":
    main()
