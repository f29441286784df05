"""Run registered queries next to their SQL and compare rows by value."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else ("d", repr(v + 0.0))
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, int):
        return ("i", v)
    return repr(v)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(c for c in columns), Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, connection, plan, sql, sf_dir):
    t = time.time()
    df = plan(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    spent = time.time() - t
    if sql is None:
        return "rows-only", len(rows), spent, ""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    mine, theirs = bag(df.columns, rows), bag(names, result.fetchall())
    if mine == theirs:
        return "ok", len(rows), spent, ""
    if mine[0] != theirs[0]:
        return "COLUMNS", len(rows), spent, f"{set(mine[0]) ^ set(theirs[0])}"
    a, b = mine[1] - theirs[1], theirs[1] - mine[1]
    return "DIFF", len(rows), spent, f"spark-only {sum(a.values())}: {list(a)[:3]}\n   sql-only {sum(b.values())}: {list(b)[:3]}"


def connect(sf_dir):
    import duckdb
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


if __name__ == "__main__":
    import __spark_entry__ as entry
    from meetlake.session import build_session
    sf = sys.argv[1]
    sf_dir = f"/root/testdata/sf{sf}"
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    plans, sqls = entry.queries(), entry.oracle_sql()
    bad = []
    for name, plan in plans.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            state, n, spent, note = compare(spark, con, plan, sqls.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            state, n, spent, note = "ERROR", 0, 0.0, str(exc)[:1500]
        print(f"{state:10s} {name:28s} rows={n:<8d} {spent:6.2f}s {note}", flush=True)
        if state not in ("ok", "rows-only"):
            bad.append(name)
    print("FAILED:", bad)
