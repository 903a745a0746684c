"""Compare registered queries with their SQL in DuckDB.

``python tests/compare.py [sf0.01] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import hashlib
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def digest(rows) -> str:
    return hashlib.sha256(repr(rows).encode()).hexdigest()


def compare(spark, con, sf_dir: str, name: str, run, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    df = run(spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {spent:.1f}s"
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    want = _rows(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns differ: {sorted(set(columns) ^ set(df.columns))}"
    names = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN", "date": "DATE", "smallint": "SMALLINT"}
    off = [(c, t, types[c]) for c, t in df.dtypes if names.get(t) != types[c]]
    if off:
        return False, f"types differ: {off}"
    if digest(got) != digest(want):
        a, b = set(got) - set(want), set(want) - set(got)
        return False, f"rows {len(got)} vs {len(want)}; differing {len(a)}/{len(b)}; {sorted(a, key=repr)[:1]} vs {sorted(b, key=repr)[:1]}; {sorted(columns)}"
    return True, f"{len(got)} rows, {spent:.1f}s"


def main(argv):
    import __spark_entry__ as e

    from tickloom.session import local_session

    sf = next((a for a in argv if a.startswith("sf")), "sf0.01")
    wanted = [a for a in argv if not a.startswith("sf")]
    sf_dir = f"/root/testdata/{sf}"
    spark, con = local_session(), connect(sf_dir)
    oracles, bad = e.oracle_sql(), []
    for name, run in e.queries().items():
        if wanted and not any(w == name or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            ok, note = compare(spark, con, sf_dir, name, run, oracles.get(name))
        except Exception as ex:  # noqa: BLE001
            ok, note = False, f"{type(ex).__name__}: {str(ex)[:600]}"
        if not ok:
            bad.append(name)
        print("ok  " if ok else "FAIL", name, note[:900], flush=True)
    print(len(bad), "failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
