"""Compare every registered query with its oracle: rows, columns, values. Usage: check.py [sf] [name-prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if hasattr(v, "isoformat"):
        return str(v)[:26]
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    return float(v) if type(v).__name__ == "Decimal" else v


def key(row):
    return tuple((v is None, type(v).__name__, v) for v in row)


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b
    return a == b


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    from candlewick.plans.registry import ORACLES, QUERIES
    from candlewick.session import build_session
    import candlewick.plans as plans
    import importlib
    for m in plans.MODULES:
        try:
            importlib.import_module(f"candlewick.plans.{m}")
        except ModuleNotFoundError as e:
            print("skip", m, e)
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = []
    for name, query in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            df = query(spark, sf_dir)
            cols = sorted(df.columns)
            got = [tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
            t1 = time.time()
            if name not in ORACLES:
                print(f"rows  {name:38s} {len(got):7d} rows {t1 - t0:6.2f}s")
                if not got:
                    bad.append(name)
                continue
            rel = con.sql(ORACLES[name])
            names = rel.columns
            if sorted(names) != cols:
                print(f"COLS  {name} spark={cols} sql={sorted(names)}")
                bad.append(name)
                continue
            order = [names.index(c) for c in cols]
            exp = [tuple(norm(r[i]) for i in order) for r in rel.fetchall()]
            t2 = time.time()
            got.sort(key=key), exp.sort(key=key)
            diff = [(a, b) for a, b in zip(got, exp) if not all(close(x, y) for x, y in zip(a, b))]
            ok = len(got) == len(exp) and not diff and got
            kinds = dict(df.dtypes)
            print(f"{'ok   ' if ok else 'FAIL '} {name:38s} {len(got):7d} rows {t1 - t0:6.2f}s sql {t2 - t1:5.2f}s")
            if not ok:
                bad.append(name)
                print("   cols", [(c, kinds[c]) for c in cols], "rows", len(got), len(exp), "diffs", len(diff))
                for a, b in diff[:2]:
                    print("   spark", a)
                    print("   sql  ", b)
            else:
                null = [c for i, c in enumerate(cols) if all(r[i] is None for r in got)]
                const = [c for i, c in enumerate(cols) if len(got) > 20 and len({repr(r[i]) for r in got}) == 1]
                if null or const:
                    print("   all-null", null, "constant", const)
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"ERROR {name}: {str(e)[:1500]}")
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
