"""Runs a query and its SQL over the same tables and compares all values."""

from __future__ import annotations

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=str), [columns[i] for i in order]


def same(spark, query, sql: str, sf_dir: str) -> None:
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(sql)
    want, names = rows([d[0] for d in got.description], got.fetchall())
    df = query(spark, sf_dir)
    have, columns = rows(df.columns, [tuple(r) for r in df.collect()])
    assert columns == names
    assert len(have) == len(want)
    for a, b in zip(have, want, strict=True):
        assert a == b
