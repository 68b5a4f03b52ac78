"""Run a query and its SQL check side by side."""

from __future__ import annotations

import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(path: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(path, table)}.parquet'")
    return con


def difference(spark_df, con, sql: str) -> str | None:
    """None when both sides hold the same rows, else what differs."""
    ours = spark_df.toPandas()
    theirs = con.execute(sql).df()
    names = sorted(ours.columns)
    if names != sorted(theirs.columns):
        return f"columns {names} against {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    for n in names:
        # A column of integers with nulls comes as floats on one side and as Int64 on the other.
        if theirs[n].dtype.kind == "i" and ours[n].dtype.kind == "f" and ours[n].isna().any():
            ours[n], theirs[n] = ours[n].astype("Int64"), theirs[n].astype("Int64")
    kinds = {
        n: (ours[n].dtype.kind, theirs[n].dtype.kind)
        for n in names
        if ours[n].dtype != theirs[n].dtype and "f" in (ours[n].dtype.kind + theirs[n].dtype.kind)
    }
    if kinds:
        return f"types differ: {kinds}"
    ints = {n: (str(ours[n].dtype), str(theirs[n].dtype)) for n in names if ours[n].dtype != theirs[n].dtype and ours[n].dtype.kind == "i"}
    if ints:
        return f"integer types differ: {ints}"
    a = sorted(map(repr, ours[names].itertuples(index=False, name=None)))
    b = sorted(map(repr, theirs[names].itertuples(index=False, name=None)))
    if a != b:
        only, other = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
        return f"values differ: {only} against {other}"
    return None
