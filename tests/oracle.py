"""Results of a query beside those of its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(v):
    """A value so that both engines' can be compared: floats to six digits, lists and structs by part."""
    if v is None or isinstance(v, float) and math.isnan(v) or type(v).__name__ in ("NAType", "NaTType"):
        return "null"
    if isinstance(v, (str, bool)):
        return str(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, dict):
        return str({k: plain(x) for k, x in v.items()})
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    try:
        return f"{float(v):.6g}"
    except (TypeError, ValueError):
        return str(v)


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(map(plain, r)) for r in pdf[cols].itertuples(index=False))


def assert_same(got, want):
    (a, x), (b, y) = rows(got), rows(want)
    assert a == b
    assert len(x) == len(y)
    assert x == y
