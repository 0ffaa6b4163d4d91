"""Run registered queries next to their checking SQL: python tests/check.py [sf_dir] [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


def rows_of(table) -> tuple[list[str], list[tuple]]:
    """Column names in order, and all rows as sorted text tuples."""
    columns = sorted(table.column_names)
    data = [table.column(c).to_pylist() for c in columns]
    return columns, sorted(tuple(map(_cell, r)) for r in zip(*data))


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    table = fn(spark, sf_dir).toArrow()
    got = rows_of(table)
    if sql is None:
        return len(got[1]) > 0, f"{len(got[1])} rows, no SQL"
    checked = con.execute(sql).to_arrow_table()
    want = rows_of(checked)
    kinds = {
        c: (str(table.schema.field(c).type), str(checked.schema.field(c).type))
        for c in table.column_names
        if c in checked.column_names
    }
    other = {c: k for c, k in kinds.items() if k[0] != k[1]}
    if got == want:
        return not other, f"{len(got[1])} rows {other or ''}"
    if got[0] != want[0]:
        return False, f"columns {got[0]} vs {want[0]}"
    extra = [r for r in got[1] if r not in set(want[1])][:2]
    lacking = [r for r in want[1] if r not in set(got[1])][:2]
    return False, f"{len(got[1])} vs {len(want[1])} rows\n   got  {extra}\n   want {lacking}"


def main() -> None:
    import __spark_entry__ as entry
    from formulary.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = local_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(sf_dir), entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - start:6.2f}s {note}", flush=True)
    print(f"{bad} failed", flush=True)


if __name__ == "__main__":
    main()
