"""Run SQL over the driver tables and compare it with a DataFrame, whatever the order of rows and columns."""

import datetime
import decimal
import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def connect(folder=SF):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for name in os.listdir(folder):
        path = os.path.join(folder, name)
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else f"{float(value):.9g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in records)


def of_sql(connection, sql):
    found = connection.execute(sql)
    return rows([c[0] for c in found.description], found.fetchall())


def of_frame(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])
