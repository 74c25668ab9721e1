"""Runs a query and its SQL over the same tables, and compares rows without regard to their order."""

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(float(f"{v:.9g}"))
    if hasattr(v, "asDict"):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return [plain(x) for x in v.values()]
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return plain(v.tolist()) if hasattr(v, "tolist") else v


def same(spark, con, query, sql, folder):
    df = query(spark, folder)
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    places = [names.index(c) for c in df.columns]
    left = sorted(repr([plain(v) for v in r]) for r in df.collect())
    right = sorted(repr([plain(r[i]) for i in places]) for r in got.fetchall())
    assert left == right
    return len(left)
