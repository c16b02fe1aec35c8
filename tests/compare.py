"""Run a query and its SQL on one directory and say how they differ."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        if (p := Path(sf_dir, f"{t}.parquet")).exists():
            c.execute(f"create view {t} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    return float(x) if type(x).__name__ == "Decimal" else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: [(x is None, str(x)) for x in r])


def difference(df, connection, sql: str) -> str | None:
    mine = rows(df.columns, df.collect())
    done = connection.execute(sql)
    theirs = rows([d[0] for d in done.description], done.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} and {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} and {len(theirs[1])} rows"
    wrong = [(a, b) for a, b in zip(mine[1], theirs[1], strict=True) if a != b]
    return f"{len(wrong)} rows differ, as {wrong[0]}" if wrong else None
