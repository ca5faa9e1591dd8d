"""Compares a query's rows with its SQL's."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if v is None or v is pd.NA:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if v != v else int(v) if v == int(v) else round(v, 6)
    return v


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr(tuple(map(value, r))) for r in frame.itertuples(index=False, name=None))


def same(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    kinds = {r[0]: r[1].lower() for r in con.execute("DESCRIBE " + sql).fetchall()}
    names = {"int": "integer", "string": "varchar", "bigint": "bigint", "boolean": "boolean", "double": "double"}
    assert kinds == {n: names.get(t, t) for n, t in df.dtypes}
    assert rows(df.toPandas()) == rows(con.execute(sql).fetchdf())
