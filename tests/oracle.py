"""Side-by-side run of a registered query and its SQL twin."""

import glob
import math
import os

import duckdb

DATA = os.environ.get("FRAMELARK_DATA", "/root/testdata/sf0.01")


def connect(sf_dir=DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(x):
    if x is None:
        return (0, "")
    if isinstance(x, float):
        if math.isnan(x):
            return (1, "nan")
        return (1, repr(x))
    if hasattr(x, "item"):
        return _cell(x.item())
    if isinstance(x, (list, tuple)):
        return (3, repr([_cell(v) for v in x]))
    return (2, type(x).__name__ + ":" + str(x))


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        tuple(_cell(row[i]) for i in order) for row in rows
    )


def compare(spark, name, fn, sql, sf_dir=DATA):
    """Empty string when equal, else what differs."""
    got = fn(spark, sf_dir)
    mine = canonical(got.columns, [tuple(r) for r in got.collect()])
    cur = connect(sf_dir).execute(sql)
    theirs = canonical([d[0] for d in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} vs {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} vs {len(theirs[1])}"
    if not mine[1]:
        return "no rows"
    bad = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    return f"{len(bad)} of {len(mine[1])} rows differ, e.g. {bad[0]}" if bad else ""
