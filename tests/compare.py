"""Run registered queries beside their SQL and compare rows as multisets.

    python tests/compare.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v


def difference(spark, connection, sf_dir: str, run, sql: str) -> str | None:
    """None when equal, else what differs."""
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    ours = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    found = connection.sql(sql)
    if sorted(found.columns) != names:
        return f"columns {names} and {sorted(found.columns)}"
    picked = found.select(*[f'"{n}"' for n in names])
    theirs = Counter(tuple(plain(v) for v in r) for r in picked.fetchall())
    if ours == theirs:
        kinds = dict(zip(found.columns, map(str, found.types)))
        expected = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
        odd = [(n, k, kinds[n]) for n, k in df.dtypes if expected.get(k) != kinds[n]]
        return f"types {odd}" if odd else None
    a, b = ours - theirs, theirs - ours
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; ours {list(a)[:2]}; sql {list(b)[:2]}"[:900]


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from millrace.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    connection, oracle = connect(sf_dir), oracle_sql()
    good = 0
    for name, run in queries().items():
        if wanted and name not in wanted:
            continue
        began = time.time()
        try:
            if name in oracle:
                said = difference(spark, connection, sf_dir, run, oracle[name])
            else:
                said = f"rows only: {len(run(spark, sf_dir).collect())}"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:600]}"
        good += said is None
        print(f"{time.time() - began:6.2f}s {name}: {said or 'equal'}", flush=True)
    print(good, "equal of", len(oracle))
