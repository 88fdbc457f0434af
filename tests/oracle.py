"""Comparison of a query with its SQL on the same tables."""

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def differences(df, con, sql):
    """Empty, or what differs."""
    rel = con.sql(sql)
    a, b = sorted(df.columns), sorted(rel.columns)
    if a != b:
        return f"columns {a} and {b}"
    ours = Counter(tuple(plain(r[c]) for c in a) for r in df.collect())
    at = [rel.columns.index(c) for c in a]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    if ours != theirs:
        return f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours {list((ours - theirs).items())[:3]}; only SQL {list((theirs - ours).items())[:3]}"
    return "" if ours else "no rows"
