"""Run registered queries and compare them with their SQL on the same tables.

    python tests/compare.py [--sf DIR] [name ..]
"""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KINDS = {"tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "int",
         "hugeint": "hugeint", "double": "float", "float": "float", "string": "str",
         "varchar": "str", "boolean": "bool", "timestamp": "ts"}


def kind(name: str) -> str:
    return KINDS.get(name.lower(), name.lower())


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def duck(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def compare(spark, con, name: str, folder: str, plans, sql) -> tuple[str, str, float, float]:
    start = time.time()
    df = plans[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    spark_s = time.time() - start
    if name not in sql:
        return ("rows", f"{len(got)} rows", spark_s, 0.0)
    start = time.time()
    res = con.execute(sql[name])
    names = [d[0] for d in res.description]
    want = res.fetchall()
    duck_s = time.time() - start
    types = {n: kind(str(t[1]).split("(")[0]) for n, t in zip(names, res.description)}
    if sorted(names) != sorted(df.columns):
        return ("BAD", f"columns {sorted(df.columns)} vs {sorted(names)}", spark_s, duck_s)
    duck_types = dict(zip(names, [r[1] for r in con.execute(
        f"describe {sql[name]}").fetchall()]))
    off = [f"{n}:{t}/{duck_types[n]}" for n, t in df.dtypes if kind(t) != kind(duck_types[n])]
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        only_a = [x for x in a if x not in set(map(tuple, b))][:2]
        return ("BAD", f"{len(a)} rows vs {len(b)} {only_a}"[:700], spark_s, duck_s)
    bad = [(x, y) for x, y in zip(a, b) if repr(x) != repr(y)]
    if bad:
        x, y = bad[0]
        diff = [(p, q) for p, q in zip(x, y) if repr(p) != repr(q)]
        return ("BAD", f"{len(bad)}/{len(a)} differ, key {str(x[0])[:60]!r}: "
                f"{str(diff[0][0])[-300:]!r} != {str(diff[0][1])[-300:]!r}", spark_s, duck_s)
    if not a:
        return ("EMPTY", "no rows", spark_s, duck_s)
    return (("TYPE" if off else "ok"), f"{len(a)} rows {off or ''}", spark_s, duck_s)


def main() -> int:
    args = sys.argv[1:]
    folder = "/root/testdata/sf0.01"
    if "--sf" in args:
        i = args.index("--sf")
        folder = args[i + 1]
        del args[i:i + 2]
    from colloquy.plans import catalog
    from colloquy.session import build_session
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    names = [n for n in catalog.PLANS if not args or any(a == n or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    if args and args[0].startswith("@"):
        module = args[0][1:]
        names = [n for n, m in catalog.registry.WHERE.items() if m.endswith(module)]
    failed = 0
    for name in names:
        try:
            status, note, s, d = compare(spark, con, name, folder, catalog.PLANS, catalog.SQL)
        except Exception as e:  # noqa: BLE001
            status, note, s, d = "ERROR", str(e)[:900], 0, 0
        failed += status in ("BAD", "ERROR", "EMPTY", "TYPE")
        print(f"{status:6} {name:28} {s:6.2f}s {d:6.2f}s  {note}", flush=True)
    print(f"{len(names)} queries, {failed} not ok")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
