"""Rows of a Spark query and of SQL, made comparable."""

import math
from collections import Counter

import duckdb

from quire.runtime import TABLES


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


def rows_of(df):
    columns = sorted(df.columns)
    return columns, Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())


def rows_of_sql(sql, folder):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    columns = sorted(names)
    places = [names.index(c) for c in columns]
    return columns, Counter(tuple(plain(r[i]) for i in places) for r in cursor.fetchall())
