"""Compare registered queries with their SQL on DuckDB: row count, columns and values, in any order."""

from __future__ import annotations

import os
import sys
from collections import Counter
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return str(v) if v is not None and not isinstance(v, (int, str, bool)) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark, sf_dir, name, query, sql):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = query(spark, sf_dir)
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    want = rows_of(columns, found.fetchall())
    have = rows_of(got.columns, [tuple(r) for r in got.collect()])
    if sorted(columns) != sorted(got.columns):
        return f"{name}: columns {sorted(got.columns)} against {sorted(columns)}"
    if want != have:
        return f"{name}: {sum(have.values())} rows against {sum(want.values())}; only here {list((have - want).items())[:2]}, only there {list((want - have).items())[:2]}"
    return "" if want else f"{name}: no rows to compare"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    queries, sql = entry.queries(), entry.oracle_sql()
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    for n in sys.argv[1:] or queries:
        try:
            said = differences(session, sf, n, queries[n], sql[n]) or "ok" if n in sql else f"{queries[n](session, sf).count()} rows, no SQL"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:700]}"
        print(n, said, flush=True)
