"""Run queries next to their SQL on the given tables and compare the rows.

    python tests/check_oracles.py [table folder] [name prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        if math.isinf(v) or math.isnan(v):
            return str(v)
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return v


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want_rows = rel.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got = Counter(tuple(cell(r[n]) for n in names) for r in df.collect())
    want = Counter(tuple(cell(v) for v in r) for r in want_rows)
    if got == want:
        types = dict(zip(names, (str(d[1]) for d in rel.description)))
        for f in df.schema.fields:
            s, d = f.dataType.simpleString(), types[f.name]
            ok = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
            if s in ok and ok[s] != d:
                return f"type of {f.name}: {s} vs {d}"
        return None
    only_got, only_want = got - want, want - got
    return f"rows {sum(got.values())} vs {sum(want.values())}; only spark {str(list(only_got)[:2])[:700]}; only sql {str(list(only_want)[:2])[:700]}"


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = tuple(sys.argv[2:])
    spark, con, bad = session(), connect(sf_dir), 0
    sqls = oracle_sql()
    for name, run in queries().items():
        if wanted and not name.startswith(wanted):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in sqls:
                diff = compare(df, con, sqls[name])
            else:
                n = len(df.collect())
                diff = None if n else "no rows"
        except Exception as e:
            diff = f"{type(e).__name__}: {str(e)[:600]}"
        bad += diff is not None
        kind = "sql " if name in sqls else "rows"
        print(f"{'ok ' if diff is None else 'BAD'} {kind} {time.time() - start:6.2f}s {name} {diff or ''}", flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
