"""Compares a query with its SQL over the same tables."""

import glob
import os

import duckdb


def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def rows_of(frame):
    names = sorted(frame.columns)
    plain = frame[names].astype(object).where(frame[names].notna(), None)
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in plain.values.tolist()), key=str)


def same(left, right, tolerance=1.1e-6):
    assert sorted(left.columns) == sorted(right.columns)
    a, b = rows_of(left), rows_of(right)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for p, q in zip(x, y, strict=True):
            assert p == q or (isinstance(p, (int, float)) and isinstance(q, (int, float)) and abs(p - q) <= tolerance * max(1, abs(p))), (x, y)
