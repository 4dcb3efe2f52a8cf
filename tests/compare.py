"""Results of a query and of its SQL as sorted, normalised rows."""

import glob
import os

import duckdb


def connect(data_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{data_dir}/*.parquet"):
        src = p if os.path.isfile(p) else f"{p}/*.parquet"
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{src}'")
    return con


def norm(v, side, inside=False):
    """Text of a value: NaN is equal to none, numbers in lists are exact with the sign of their zeros, others have nine digits and one zero."""
    if isinstance(v, float):
        return f"nan of {side}" if v != v else repr(v) if inside else f"{v + 0.0:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x, side, True) for x in v) + "]"
    return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(norm(r[c], 'spark') for c in cols) for r in df.collect())


def sql_rows(con, sql):
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted(tuple(norm(r[i], 'sql') for i in at) for r in res.fetchall())
