"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_DATA", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect(config={"memory_limit": "4GB", "threads": 4})
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def rows(df: pd.DataFrame) -> Counter:
    def plain(x: object) -> object:
        if x is None or (isinstance(x, float) and x != x):
            return None
        if isinstance(x, bool) or not hasattr(x, "__float__"):
            return str(x)
        return round(float(x), 6)

    columns = sorted(df.columns)
    return Counter(tuple(plain(x) for x in r) for r in df[columns].astype(object).itertuples(index=False))


def differences(spark, query, sql: str, sf_dir: str) -> str:  # noqa: ANN001
    """Empty if the results are equal."""
    got = query(spark, sf_dir).toPandas()
    want = connect(sf_dir).execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} against {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a == b:
        return ""
    return f"{len(got)} rows against {len(want)}; only here {list((a - b).items())[:3]}, only SQL {list((b - a).items())[:3]}"
