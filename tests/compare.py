"""Run registered queries against their SQL statements in DuckDB (also usable as a script)."""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(names: list[str], values) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def differences(spark, sf: str, query, sql: str, con=None) -> list[str]:
    con = con or connect(sf)
    df = query(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows(names, cur.fetchall())
    out = []
    if sorted(df.columns) != sorted(names):
        out.append(f"columns {sorted(df.columns)} != {sorted(names)}")
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        only_got = [r for r in got if r not in set(want)][:2]
        only_want = [r for r in want if r not in set(got)][:2]
        out.append(f"spark only {str(only_got)[:600]}\n   sql only {str(only_want)[:600]}")
    return out


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from scholion.plans import collect
    from scholion.session import build_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.driver.memory": "12g", "spark.sql.session.timeZone": "Etc/UTC"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = collect()
    con = connect(sf)
    bad = 0
    for name, query in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            if name in oracles:
                diff = differences(spark, sf, query, oracles[name], con)
                n = con.execute(f"SELECT count(*) FROM ({oracles[name]})").fetchall()[0][0]
                print(f"{'FAIL' if diff else 'ok  '} {name:34s} {time.time() - t:6.2f}s rows={n}", *diff)
                bad += bool(diff)
            else:
                got = query(spark, sf).collect()
                print(f"rows {name:34s} {time.time() - t:6.2f}s rows={len(got)}", str(got[:1])[:200])
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"ERR  {name:34s} {str(error)[:1500]}")
    print("bad:", bad)
