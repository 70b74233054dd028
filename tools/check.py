"""Run registered queries beside their SQL twins in DuckDB and report differences.

usage: python tools/check.py [--sf 0.01] [name or prefix ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canon(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for row in df.itertuples(index=False, name=None):
        rows.append(tuple(cell(v) for v in row))
    return sorted(rows, key=repr)


def cell(v):
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(cell(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, cell(x)) for k, x in v.items()))
    try:
        if v is None or pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return v


def main() -> int:
    args = sys.argv[1:]
    sf = "0.01"
    if "--sf" in args:
        at = args.index("--sf")
        sf = args[at + 1]
        del args[at : at + 2]
    from marketspark.catalog import ORACLE, QUERIES
    from marketspark.session import build_session

    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    names = [n for n in QUERIES if not args or any(n == a or n.startswith(a) for a in args)]
    bad = 0
    for name in names:
        start = time.time()
        try:
            frame = QUERIES[name](spark, sf_dir)
            got = frame.toPandas()
            took = time.time() - start
            if name not in ORACLE:
                print(f"rows  {name:28s} {len(got):7d} rows {took:6.2f}s  (no SQL)", flush=True)
                continue
            result = con.execute(ORACLE[name])
            want = result.fetchdf()
            kinds = {d[0]: str(d[1]) for d in result.description}
            if sorted(got.columns) != sorted(want.columns):
                bad += 1
                print(f"COLS  {name}: {sorted(got.columns)} vs {sorted(want.columns)}", flush=True)
                continue
            a, b = canon(got), canon(want)
            if a == b:
                note = ""
                spark_types = dict(frame.dtypes)
                odd = [c for c in want.columns if _family(spark_types[c]) != _family(kinds[c].lower())]
                if odd:
                    note = "types: " + ", ".join(f"{c} {spark_types[c]}/{kinds[c]}" for c in odd)
                print(f"ok    {name:28s} {len(got):7d} rows {took:6.2f}s {note}", flush=True)
            else:
                bad += 1
                diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
                print(f"DIFF  {name}: {len(a)} vs {len(b)} rows; first {diff}", flush=True)
        except Exception as error:  # report and go on
            bad += 1
            print(f"FAIL  {name}: {str(error)[:1500]}", flush=True)
    print("bad:", bad)
    return bad


def _family(kind: str) -> str:
    kind = kind.lower()
    for key, family in (
        ("array", "list"), ("[]", "list"), ("list", "list"), ("map", "map"), ("hugeint", "hugeint"), ("bigint", "bigint"), ("timestamp", "timestamp"), ("number", "number"),
        ("double", "double"), ("float", "float"), ("int", "int"), ("string", "string"), ("varchar", "string"), ("bool", "bool"), ("date", "date"),
    ):
        if key in kind:
            return family
    return kind


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
