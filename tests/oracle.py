"""Compare a query with its SQL on the driver's tables."""

import os

import duckdb

DATA = "/root/testdata"


def connection(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6)
    if isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    return value


def rows(table, columns):
    got = table.select(columns).to_pylist()
    return sorted(([plain(r[c]) for c in columns] for r in got), key=lambda r: [(x is not None, str(x)) for x in r])


def assert_same(spark, con, query, sql, sf_dir):
    mine = query(spark, sf_dir).toArrow()
    other = con.sql(sql).to_arrow_table()
    columns = sorted(mine.column_names)
    assert columns == sorted(other.column_names)
    assert rows(mine, columns) == rows(other, columns)
