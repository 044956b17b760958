"""Rows of a query against rows of its SQL, in any order."""

import os

import duckdb


def plain(rows, columns, wanted):
    at = [columns.index(c) for c in wanted]
    out = []
    for row in rows:
        cells = []
        for k in at:
            v = row[k]
            cells.append("~" if v is None or v != v else str(v) if isinstance(v, bool | str) else repr(round(float(v), 9) + 0.0) if isinstance(v, int | float) else str(v))
        out.append(tuple(cells))
    return sorted(out)


def same(spark, query, sql, folder):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    df = query(spark, folder)
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    columns = sorted(df.columns)
    assert plain(df.collect(), df.columns, columns) == plain(rel.fetchall(), rel.columns, columns)
