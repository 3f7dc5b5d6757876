"""Compares a query with its DuckDB SQL on the same tables."""

import glob
import os

import duckdb


def rows(df):
    columns = sorted(df.columns)
    df = df[columns].astype(object).where(df[columns].notna(), None)
    show = lambda v: "null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(int(v)) if hasattr(v, "dtype") and v.dtype.kind in "iu" else str(v)
    return columns, sorted("|".join(map(show, r)) for r in df.itertuples(index=False))


def same(spark, sf_dir, query, sql):
    db = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    assert rows(query(spark, sf_dir).toPandas()) == rows(db.execute(sql).df())
