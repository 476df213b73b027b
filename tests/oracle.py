"""Compares a query's rows with those of its SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "~"
    if isinstance(x, float):
        return f"{x:.6g}" if x else "0"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(_cell, x)) + "]"
    return str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted(tuple(_cell(r[k]) for k in order) for r in rows)


def compare(spark, f, sql, sf_dir):
    """None if equal, else what differs."""
    df = f(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    types = {d[0]: str(d[1]).upper() for d in cur.description}
    kind = lambda t: "float" if t in ("DOUBLE", "FLOAT", "NUMBER") or "DECIMAL" in t else "int" if "INT" in t else t
    spark_kind = {"double": "float", "float": "float", "int": "int", "bigint": "int", "smallint": "int", "tinyint": "int"}
    bad = [(c, t, types.get(c)) for c, t in df.dtypes if c in types and spark_kind.get(t) in ("int", "float") and kind(types[c]) in ("int", "float") and kind(types[c]) != spark_kind[t]]
    if bad:
        return f"types {bad}"
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows and {len(want[1])}"
    off = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return f"{len(off)} of {len(got[1])} rows differ, such as {off[0]}" if off else None
