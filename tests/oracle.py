"""Run a registered query and its SQL side by side and compare the two results."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v + 0.0:.9g}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


KIND = {
    "bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "hugeint": "int", "integer": "int",
    "double": "float", "float": "float", "string": "str", "varchar": "str", "boolean": "bool",
    "timestamp": "ts", "timestamp_ntz": "ts", "date": "date",
}


def compare(spark, con, fn, sql: str, sf_dir: str) -> list[str]:
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(_norm(row[c]) for c in cols) for row in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = [tuple(_norm(row[names.index(c)]) for c in cols) for row in cur.fetchall()] if sorted(names) == cols else None
    if want is None:
        return [f"columns differ: {cols} / {sorted(names)}"]
    problems = []
    sk = {f.name: KIND.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    dk = {d[0]: KIND.get(str(d[1]).lower(), str(d[1]).lower()) for d in cur.description}
    problems += [f"type of {c}: {sk[c]} / {dk[c]}" for c in cols if sk[c] != dk[c]]
    if len(got) != len(want):
        problems.append(f"rows: {len(got)} / {len(want)}")
    if not got:
        problems.append("no rows")
    got.sort(), want.sort()
    if got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b][:3]
        only = list(set(got) - set(want))[:2], list(set(want) - set(got))[:2]
        problems.append(f"values differ {cols}: {bad} only-here/only-there {only}")
    return problems
