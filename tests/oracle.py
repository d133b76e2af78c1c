"""Run queries next to their DuckDB oracles and compare whole results."""

from __future__ import annotations

import decimal
import math
import signal
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.9g}"
    if isinstance(v, int):
        return f"{v:.9g}" if abs(v) < 10**9 else str(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return str(v)


def _type(name: str) -> str:
    n = str(name).lower()
    if n.startswith(("bigint", "int", "hugeint", "long", "smallint", "short")):
        return "int" if not n.startswith("hugeint") else "hugeint"
    if n.startswith(("double", "float", "decimal")):
        return "double" if not n.startswith("decimal") else "decimal"
    if n.startswith(("varchar", "string", '"null"', "void")):
        return "string"
    return n


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    names = sorted(spark_df.columns)
    got_rows = spark_df.select(*[f"`{n}`" for n in names]).collect()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    types = {d[0]: _type(d[1]) for d in cur.description}
    want_rows = cur.fetchall()
    if sorted(cols) != names:
        return False, f"columns {names} != {sorted(cols)}"
    ours = {f.name: _type(f.dataType.simpleString()) for f in spark_df.schema.fields}
    off = {c: (ours[c], types[c]) for c in names if ours[c] != types[c]}
    idx = [cols.index(n) for n in names]
    got = sorted((tuple(_norm(v) for v in r) for r in got_rows), key=repr)
    want = sorted((tuple(_norm(r[i]) for i in idx) for r in want_rows), key=repr)
    if len(got) != len(want):
        return False, f"{len(got)} rows, oracle {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)}/{len(got)} rows differ, e.g. {names} got {bad[0][0]} want {bad[0][1]}"
    if off:
        return False, f"types differ {off}"
    return True, f"{len(got)} rows"


def main(argv: list[str]) -> int:
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from coobs.session import local_session

    sf = argv[0] if argv else "0.01"
    wanted = argv[1:]
    spark = local_session()
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []

    def late(*_):
        raise TimeoutError("query took too long")

    signal.signal(signal.SIGALRM, late)
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        signal.alarm(150)
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                t1 = time.time()
                ok, note = compare(df, con, oracles[name])
            else:
                ok, note = True, f"{df.count()} rows, no oracle"
                t1 = t0
        except Exception as e:
            ok, note, t1 = False, f"{type(e).__name__}: {str(e)[:600]}", t0
        signal.alarm(0)
        if not ok:
            spark.sparkContext.cancelAllJobs()
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t0:.1f}s {note}", flush=True)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
