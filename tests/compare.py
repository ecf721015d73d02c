"""Runs registered queries next to their DuckDB checks and compares the results."""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from workloom.sources.catalog import GIVEN  # noqa: E402


def duck(folder):
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return 0.0 if value == 0 else value
    return value


def kind(value):
    return "null" if value is None else type(value).__name__


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple(str(x) for x in r))


def compare(spark_df, con, sql):
    """Empty string when equal, else what differs."""
    names = spark_df.columns
    mine = rows_of(names, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    theirs_names = [d[0] for d in cur.description]
    wide = [f"{d[0]}:{d[1]}" for d in cur.description if "HUGEINT" in str(d[1]) or "DECIMAL" in str(d[1])]
    theirs = rows_of(theirs_names, cur.fetchall())
    if sorted(names) != sorted(theirs_names):
        return f"columns {sorted(names)} != {sorted(theirs_names)}"
    if wide:
        return f"wide types {wide}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}; mine {mine[:2]} theirs {theirs[:2]}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        return f"{len(bad)}/{len(mine)} rows differ, cols {sorted(names)}: {bad[0][0]} != {bad[0][1]}"
    for a, b in zip(mine, theirs):
        if [kind(x) for x in a] != [kind(x) for x in b]:
            return f"types {[kind(x) for x in a]} != {[kind(x) for x in b]}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from workloom.session import local_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    checks = entry.oracle_sql()
    failed = 0
    total = 0.0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in checks:
                note = compare(df, con, checks[name])
                size = "-"
            else:
                size = len(df.collect())
                note = "" if size else "no rows"
        except Exception as error:  # report and go on
            note, size = f"{type(error).__name__}: {str(error)[:600]}", "-"
        took = time.time() - start
        total += took
        failed += bool(note)
        print(f"{'FAIL' if note else 'ok  '} {name:38s} {took:6.2f}s {'sql' if name in checks else 'rows ' + str(size)} {note}", flush=True)
    print("failed", failed, "seconds", round(total, 1))
