"""Run registered queries next to their SQL twins and compare.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    return "NULL" if v is None else str(v)


_KINDS = {"long": "bigint", "bigint": "bigint", "int": "int", "integer": "int", "double": "double",
          "string": "string", "varchar": "string", "date": "date"}


def mismatch(df, con, sql: str) -> str | None:
    """None where columns, types and all rows are equal, else what differs."""
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    kinds = {n: _KINDS.get(str(d[1]).lower(), str(d[1]).lower()) for n, d in zip(names, out.description)}
    theirs = out.fetchall()
    mine_kinds = {f.name: _KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    if mine_kinds != kinds:
        diff = {k: (mine_kinds.get(k), kinds.get(k)) for k in {*mine_kinds, *kinds} if mine_kinds.get(k) != kinds.get(k)}
        return f"schema {diff}"
    order = sorted(names)
    pos = [names.index(c) for c in order]
    mine = sorted(tuple(_cell(r[c]) for c in order) for r in df.collect())
    other = sorted(tuple(_cell(r[i]) for i in pos) for r in theirs)
    if len(mine) != len(other):
        return f"rows {len(mine)} against {len(other)}"
    if mine != other:
        bad = [(m, o) for m, o in zip(mine, other) if m != o]
        cells = [(order[i], a, b) for i, (a, b) in enumerate(zip(*bad[0])) if a != b]
        return f"{len(bad)} of {len(mine)} rows differ, first: {cells[:4]} in {bad[0][0][:4]}"
    return None


def main() -> None:
    from prospectra.oracle import ORACLE_SQL
    from prospectra.queries import QUERIES
    from prospectra.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8")
    spark.sparkContext.setLogLevel("FATAL")
    con = duck(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLE_SQL:
                verdict = mismatch(df, con, ORACLE_SQL[name]) or "ok"
            else:
                verdict = f"rows only: {len(df.collect())}"
        except Exception as e:  # noqa: BLE001
            verdict = f"FAILED {type(e).__name__}: {str(e)[:600]}"
        failed += verdict != "ok" and not verdict.startswith("rows only")
        print(f"{name:24s} {time.time() - start:6.2f}s {verdict}", flush=True)
    print(f"{failed} failed")
    sys.exit(failed > 0)


if __name__ == "__main__":
    main()
