"""Compare registered queries with their SQL on DuckDB: row count, columns and an order-free multiset of values."""

import glob
import os
from collections import Counter

import duckdb


def plain(v):
    if v is None or isinstance(v, (bool, str, int)):
        return v
    if isinstance(v, float):
        return "nan" if v != v else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "tzinfo"):
        return str(v.replace(tzinfo=None))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, plain(x)) for k, x in v.asDict().items()))
    return float(v) if hasattr(v, "as_integer_ratio") else str(v)


def connect(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def difference(df, con, sql):
    """Empty text if equal."""
    rel = con.sql(sql)
    cols = sorted(df.columns)
    if cols != sorted(rel.columns):
        return f"columns {cols} against {sorted(rel.columns)}"
    want = Counter(tuple(plain(v) for v in r) for r in rel.select(", ".join(f'"{c}"' for c in cols)).fetchall())
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.select(*[df[f"`{c}`"] for c in cols]).collect())
    if got == want:
        return ""
    return f"rows {sum(got.values())} against {sum(want.values())}; only here {list((got - want).items())[:2]}; only there {list((want - got).items())[:2]}"
