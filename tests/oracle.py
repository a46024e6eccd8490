"""A Spark result against DuckDB's: rows as sorted tuples, doubles to six digits."""

import glob

import duckdb

from tests.conftest import DATA


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def plain(v):
        return None if v is None else round(float(v), 6) if isinstance(v, float) else int(v) if isinstance(v, bool) else v

    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def duck(sql, sf):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {p.split('/')[-1][:-8]} AS SELECT * FROM '{p}'")
    out = con.execute(sql)
    return rows([c[0] for c in out.description], out.fetchall())


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])
