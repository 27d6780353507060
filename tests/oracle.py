"""Runs a query and its SQL on the same tables and compares the rows."""

import glob
import math
import os

import duckdb

SMALL = "/root/testdata/sf0.001"
ORACLE = "/root/testdata/sf0.01"


def views(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def flat(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(flat(v) for v in value)
    if isinstance(value, bool) or value is None:
        return value
    if hasattr(value, "asDict"):
        return tuple(flat(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, flat(v)) for k, v in value.items()))
    if type(value).__name__ == "Decimal":
        return float(value)
    if isinstance(value, int):
        return value
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([names[i] for i in order]), sorted((tuple(flat(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, query, sql, folder=ORACLE, con=None):
    con = con or views(folder)
    df = query(spark, folder)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    theirs = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    assert ours[0] == theirs[0], (ours[0], theirs[0])
    a, b = ours[1], theirs[1]
    if a != b:
        extra, lost = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
        raise AssertionError(f"rows {len(a)} and {len(b)}; only ours {extra}; only SQL {lost}")
    return len(a)
