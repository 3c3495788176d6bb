"""Run registered queries next to their SQL twins: python tools/compare.py [sf] [name-prefix ...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
        return canon(v)
    if isinstance(v, list):
        return str([canon(x) for x in v])
    return str(v)


def rows_of(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(canon(r[i]) for i in order) for r in records]
    return sorted(names), sorted(rows, key=lambda r: tuple("" if x is None else x for x in r))


def kind(dtype: str) -> str:
    d = dtype.lower()
    for k, words in {
        "int": ("int", "long", "short", "byte"),
        "float": ("double", "float", "decimal"),
        "str": ("string", "varchar"),
        "bool": ("bool",),
        "date": ("date",),
        "ts": ("timestamp",),
    }.items():
        if any(w in d for w in words) and not d.startswith(("array", "map", "struct")):
            if k == "int" and "hugeint" in d:
                return "hugeint"
            return k
    return d


def compare(spark, con, sf_dir: str, name: str) -> tuple[str, str, float]:
    from brierworks.plans.catalog import ORACLES, QUERIES

    t0 = time.time()
    try:
        df = QUERIES[name](spark, sf_dir)
        got = [tuple(r) for r in df.collect()]
    except Exception as e:  # noqa: BLE001
        return "ERROR", f"{type(e).__name__}: {str(e)[:600]}", time.time() - t0
    took = time.time() - t0
    if name not in ORACLES:
        return ("ROWS" if got else "EMPTY"), f"{len(got)} rows", took
    try:
        cur = con.execute(ORACLES[name])
        names = [d[0] for d in cur.description]
        types = {d[0]: str(d[1]) for d in cur.description}
        want = cur.fetchall()
    except Exception as e:  # noqa: BLE001
        return "SQLERR", str(e)[:600], took
    gc, gr = rows_of(got, df.columns)
    wc, wr = rows_of(want, names)
    if gc != wc:
        return "COLUMNS", f"{gc} vs {wc}", took
    if len(gr) != len(wr):
        return "COUNT", f"{len(gr)} vs {len(wr)}", took
    mism = [(a, b) for a, b in zip(gr, wr) if a != b]
    if mism:
        return "VALUES", f"{len(mism)}/{len(gr)} differ; cols {gc}; first {mism[0]}", took
    bad = [f"{c}:{t}/{types[c]}" for c, t in df.dtypes if kind(t) != kind(types[c])]
    note = f" TYPES {bad}" if bad else ""
    return ("OK" if gr else "EMPTY"), f"{len(gr)} rows{note}", took


def main() -> int:
    from brierworks.plans.catalog import QUERIES
    from brierworks.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    prefixes = tuple(sys.argv[2:])
    sf_dir = f"/root/testdata/{sf}"
    spark = local_session(8)
    con = connect(sf_dir)
    bad = 0
    for name in QUERIES:
        if prefixes and not name.startswith(prefixes):
            continue
        status, info, took = compare(spark, con, sf_dir, name)
        bad += status not in ("OK", "ROWS")
        print(f"{status:8s} {took:6.2f}s {name:34s} {info}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(min(main(), 1))
