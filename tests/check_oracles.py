"""Run registered queries beside their SQL on one scale and report differences: python tests/check_oracles.py [dir] [name...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from evigraph.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def canonical(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(canonical(item) for item in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, db, name, sf_dir):
    started = time.time()
    frame = entry.queries()[name](spark, sf_dir)
    got = [tuple(row) for row in frame.collect()]
    elapsed = time.time() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"{name}: {len(got)} rows, no SQL, {elapsed:.1f}s", True
    want = db.sql(sql)
    expected = want.fetchall()
    if sorted(frame.columns) != sorted(want.columns):
        return f"{name}: columns {sorted(frame.columns)} != {sorted(want.columns)}", False
    left, right = rows_of(frame.columns, got), rows_of(want.columns, expected)
    ok = left == right
    note = f"{name}: {len(left)} vs {len(right)} rows, {elapsed:.1f}s {'ok' if ok else 'DIFFERENT'}"
    if not len(left):
        note += " EMPTY"
    if not ok:
        a, b = set(map(repr, left)) - set(map(repr, right)), set(map(repr, right)) - set(map(repr, left))
        note += "\n   spark: " + "\n          ".join(sorted(a)[:4]) + "\n   sql:   " + "\n          ".join(sorted(b)[:4])
        note += f"\n   columns {sorted(frame.columns)}"
    return note, ok


def main():
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = build_session("oracles", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    names = [n for n in entry.queries() if not args or any(a in n for a in args)]
    failed = []
    for name in names:
        try:
            note, ok = compare(spark, db, name, sf_dir)
        except Exception as error:  # noqa: BLE001
            note, ok = f"{name}: ERROR {type(error).__name__} {str(error)[:900]}", False
        print(note, flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(names) - len(failed)}/{len(names)} ok; failed: {failed}")


if __name__ == "__main__":
    main()
