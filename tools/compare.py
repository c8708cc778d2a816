"""python tools/compare.py SF [NAME...]: Spark results against DuckDB on the same tables."""

import glob
import importlib.util
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def entry_module():
    spec = importlib.util.spec_from_file_location("__spark_entry__", f"{ROOT}/__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def canon(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def one(v):
        if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
            v = v.tolist()
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(one(x) for x in v) + "]"
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "∅"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (float, int)):
            return f"{float(v):.9g}"
        if isinstance(v, pd.Timestamp):
            return v.tz_localize(None).isoformat() if v.tzinfo else v.isoformat()
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        return str(v) if not hasattr(v, "as_tuple") else f"{float(v):.9g}"

    return sorted(tuple(one(v) for v in row) for row in df.itertuples(index=False, name=None))


def main() -> int:
    from tidewater.session import local_session

    entry = entry_module()
    folder = f"/root/testdata/{sys.argv[1]}"
    names = sys.argv[2:] or list(entry.queries())
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(p)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    sql, bad = entry.oracle_sql(), 0
    for n in names:
        t = time.time()
        try:
            df = entry.queries()[n](spark, folder)
            got = df.toPandas()
        except Exception as e:
            print(f"{n}: FAILED {type(e).__name__} {str(e)[:1500]}", flush=True)
            bad += 1
            continue
        took = time.time() - t
        if n not in sql:
            print(f"{n}: {len(got)} rows, no SQL, {took:.1f}s", flush=True)
            continue
        t = time.time()
        try:
            want = con.execute(sql[n]).df()
        except Exception as e:
            print(f"{n}: SQL FAILED {str(e)[:600]}", flush=True)
            bad += 1
            continue
        same = sorted(got.columns) == sorted(want.columns) and canon(got) == canon(want)
        print(f"{n}: {'ok' if same else 'DIFFERS'} {len(got)} rows / {len(want)}, {took:.1f}s, sql {time.time() - t:.1f}s", flush=True)
        if not same:
            bad += 1
            print("  columns", sorted(got.columns), sorted(want.columns))
            if sorted(got.columns) == sorted(want.columns):
                a, b = canon(got), canon(want)
                print("  only spark", [x for x in a if x not in set(b)][:3], "\n  only sql", [x for x in b if x not in set(a)][:3])
    return bad


if __name__ == "__main__":
    sys.exit(main())
