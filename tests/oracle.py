"""Runs a registered query and its SQL side by side."""

from __future__ import annotations

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, bool) or v is None:
        return v
    return float(v) if isinstance(v, int) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


def differences(spark, con, query, sql, sf_dir):
    """None if both give the same rows, else what differs."""
    df = query(spark, sf_dir)
    left, left_names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    got = con.execute(sql)
    right, right_names = rows_of([c[0] for c in got.description], got.fetchall())
    if left_names != right_names:
        return f"columns {left_names} and {right_names}"
    if len(left) != len(right):
        return f"{len(left)} and {len(right)} rows"
    bad = [(a, b) for a, b in zip(left, right, strict=True) if a != b]
    return f"{len(bad)} of {len(left)} rows differ, first {bad[0]}" if bad else None
