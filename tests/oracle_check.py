"""Run queries in Spark and their oracle in DuckDB, and compare schema and values."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, dict):
        return repr(sorted(v.items()))
    return repr(v)


def _kind(v):
    return None if v is None else type(v).__name__


def differences(spark, con, folder: str, fn, sql: str, empty_ok: bool = False) -> str | None:
    df = fn(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = [tuple(r) for r in cur.fetchall()]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if len(rows) != len(want):
        return f"rows {len(rows)} / {len(want)}"
    if not rows:
        return None if empty_ok else "no rows"
    a_idx = [df.columns.index(c) for c in sorted(names)]
    b_idx = [names.index(c) for c in sorted(names)]
    for i, j, c in zip(a_idx, b_idx, sorted(names)):
        ka = {_kind(r[i]) for r in rows} - {None}
        kb = {_kind(r[j]) for r in want} - {None}
        if ka != kb:
            return f"type of {c}: {ka} / {kb}"
    a = sorted(tuple(_cell(r[i]) for i in a_idx) for r in rows)
    b = sorted(tuple(_cell(r[j]) for j in b_idx) for r in want)
    if a != b:
        only_a = [x for x in a if x not in set(b)][:2]
        only_b = [x for x in b if x not in set(a)][:2]
        return f"values {sorted(names)}\n  spark {only_a}\n  duck  {only_b}"
    wide = {names[j]: str(d[1]) for j, d in enumerate(cur.description)}
    for f in df.schema.fields:  # a narrow type has to be the statement's own
        kind = f.dataType.simpleString()
        if kind == "float" or kind.startswith("decimal") or (kind == "int" and wide[f.name] != "INTEGER"):
            return f"narrow types {df.dtypes}"
    return None
