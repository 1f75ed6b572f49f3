"""Every catalogue query against its DuckDB twin on the smallest driver tables."""
import importlib
import math
import os
from collections import Counter

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return v


@pytest.fixture(scope="module")
def con():
    from quarry.sources.tables import TABLES
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_all_queries_match_oracle(spark, con):
    entry = importlib.import_module("__spark_entry__")
    qs, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(qs)
    bad = []
    for name, fn in sorted(qs.items()):
        df = fn(spark, SF)
        rows = df.collect()
        if name not in sqls:
            continue
        cur = con.execute(sqls[name])
        dcols = [d[0] for d in cur.description]
        if sorted(dcols) != sorted(df.columns):
            bad.append((name, "columns", df.columns, dcols))
            continue
        a = Counter(tuple(_norm(r[c]) for c in sorted(df.columns)) for r in rows)
        drows = cur.fetchall()
        b = Counter(tuple(_norm(r[dcols.index(c)]) for c in sorted(df.columns)) for r in drows)
        if a != b:
            bad.append((name, len(rows), len(drows)))
    assert not bad, bad


def test_entry_smoke(spark):
    entry = importlib.import_module("__spark_entry__")
    df = entry.entry(spark)
    assert df.columns == ["directory", "errors", "warnings", "infos", "auto_fixable", "total"]
    assert df.count() >= 0
