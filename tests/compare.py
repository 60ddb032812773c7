"""Order-insensitive comparison of a Spark result with DuckDB's."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _plain(x):
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, relation):
    assert sorted(df.columns) == sorted(relation.columns)
    assert _rows(df.columns, df.collect()) == _rows(relation.columns, relation.fetchall())
