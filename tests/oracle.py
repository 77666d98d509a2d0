"""Comparison of a query with its DuckDB SQL, as multisets of rows."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    try:
        return int(v) if v == int(v) else round(float(v), 6)
    except (TypeError, ValueError):
        return v


def same_rows(spark, query, sql: str, folder: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = query(spark, folder)
    columns = sorted(found.columns)
    expected = con.sql(sql)
    assert sorted(expected.columns) == columns
    rows = Counter(tuple(map(plain, r)) for r in found.select(*[f"`{c}`" for c in columns]).collect())
    wanted = Counter(tuple(map(plain, r)) for r in con.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({sql})").fetchall())
    assert rows == wanted, (list((rows - wanted).items())[:3], list((wanted - rows).items())[:3])
