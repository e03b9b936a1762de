"""Compare registered queries with their SQL oracles: python -m tests.oracle_check SF_DIR [names...]."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

import __spark_entry__ as entry_module
from covenantry.fixtures import TABLES
from covenantry.session import local_session


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return value


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(repr(plain(r[i])) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out)


WIDE = {"HUGEINT", "DECIMAL(38,0)"}


def check(spark, con, name, build, sql, folder):
    start = time.time()
    df = build(spark, folder)
    got = table_of(df.columns, df.collect())
    took = time.time() - start
    if sql is None:
        return True, f"rows only, {len(got[1])} rows, {took:.1f}s"
    con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in con.description}
    want = table_of(list(kinds), con.fetchall())
    wide = [c for c, k in kinds.items() if k in WIDE]
    note = f"{len(got[1])} rows, {took:.1f}s" + (f" wide {wide}" if wide else "")
    spark_kinds = dict(df.dtypes)
    alike = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
             "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}
    odd = [(c, k, kinds.get(c)) for c, k in spark_kinds.items() if alike.get(k) != kinds.get(c)]
    if odd:
        note += f" types {odd}"
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return False, (f"{note}; expected {len(want[1])} rows; only ours {[x for x in got[1] if x not in b][:2]} "
                       f"only oracle {[x for x in want[1] if x not in a][:2]}")
    return not (wide or odd), note


def main() -> int:
    folder, wanted = sys.argv[1], sys.argv[2:]
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    spark = local_session("oracle-check")
    oracles = entry_module.oracle_sql()
    bad = 0
    for name, build in entry_module.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, note = check(spark, con, name, build, oracles.get(name), folder)
        except Exception as failure:  # noqa: BLE001 - a report over all queries
            ok, note = False, f"{type(failure).__name__}: {str(failure)[:700]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
