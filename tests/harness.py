"""Runs a registered query on Spark and its counterpart on DuckDB and compares the rows."""

import datetime
import decimal
import math

import duckdb

from docuvet.plans.derive import BASE_TABLES


def connect(sf_dir):
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, run, sql, sf_dir):
    """Differences as text; empty where both sides agree."""
    df = run(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = rows_of(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}", len(ours)
    if ours != theirs:
        a, b = set(map(repr, ours)), set(map(repr, theirs))
        return f"{len(ours)}/{len(theirs)} rows; ours only {sorted(a - b)[:3]}; theirs only {sorted(b - a)[:3]}", len(ours)
    return "", len(ours)
