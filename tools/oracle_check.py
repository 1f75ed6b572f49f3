"""Run catalogue queries in Spark and their SQL twins in DuckDB; compare.

    python tools/oracle_check.py [sf_dir] [name ...]

Compares row count, column names and an order-insensitive multiset of rows
(floats rounded to 6 places). Prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from quarry.session import get_spark  # noqa: E402
from quarry.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return v


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import importlib
    entry = importlib.import_module("__spark_entry__")
    qs, sqls = entry.queries(), entry.oracle_sql()
    spark = get_spark(shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            cols = df.columns
            srows = [tuple(norm(x) for x in r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SPARK {name}: {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"rows-only {name}: {len(srows)} rows ({ts:.1f}s)")
            continue
        try:
            cur = con.execute(sqls[name])
            dcols = [d[0] for d in cur.description]
            drows = [tuple(norm(x) for x in r) for r in cur.fetchall()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SQL {name}: {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        if sorted(cols) != sorted(dcols):
            print(f"COLS {name}: spark={cols} duck={dcols}")
            bad += 1
            continue
        tmap = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
                "float": "FLOAT", "smallint": "SMALLINT"}
        stypes = {f.name: tmap.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
        dtypes = {d[0]: str(d[1]) for d in cur.description}
        tdiff = {c: (stypes[c], dtypes[c]) for c in cols if stypes[c] != dtypes[c]}
        if tdiff:
            print(f"TYPES {name}: {tdiff}")
        order = [cols.index(c) for c in sorted(cols)]
        dorder = [dcols.index(c) for c in sorted(cols)]
        a = Counter(tuple(r[i] for i in order) for r in srows)
        b = Counter(tuple(r[i] for i in dorder) for r in drows)
        if a == b:
            print(f"ok {name}: {len(srows)} rows ({ts:.1f}s)")
        else:
            bad += 1
            print(f"DIFF {name}: spark {len(srows)} rows, duck {len(drows)} rows")
            only_s = list((a - b).elements())[:3]
            only_d = list((b - a).elements())[:3]
            print("   spark-only:", [str(x)[:300] for x in only_s])
            print("   duck-only: ", [str(x)[:300] for x in only_d])
    print(f"{bad} problems")
    spark.stop()


if __name__ == "__main__":
    main()
