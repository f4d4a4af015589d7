"""Run queries() against oracle_sql() on one scale factor and compare.

Usage: python tests/oracle_compare.py [sf_dir] [key ...]

Comparison: same column names, same row count, same multiset of rows with
exact values (decimals as decimals, doubles bit-for-bit); for listings and
reports also the same order of rows.
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, decimal.Decimal):
        return ("dec", str(v))
    if isinstance(v, float):
        return ("f", v.hex())
    if isinstance(v, (dt.date, dt.datetime)):
        return ("d", v.isoformat())
    return (type(v).__name__, v)


def duck_type(spark_type) -> str:
    """The DuckDB type name a Spark column type corresponds to."""
    from pyspark.sql import types as T
    simple = {T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.DoubleType: "DOUBLE",
              T.StringType: "VARCHAR", T.DateType: "DATE", T.BooleanType: "BOOLEAN",
              T.ShortType: "SMALLINT", T.FloatType: "FLOAT", T.TimestampNTZType: "TIMESTAMP"}
    if isinstance(spark_type, T.DecimalType):
        return f"DECIMAL({spark_type.precision},{spark_type.scale})"
    for cls, name in simple.items():
        if isinstance(spark_type, cls):
            return name
    return spark_type.simpleString().upper()


def rows_key(rows):
    return sorted(tuple(_norm(v) for v in r) for r in rows)


def compare(spark, sf_dir: str, keys: list[str] | None = None, verbose: bool = True) -> dict:
    import __spark_entry__ as E
    from spendlens.plans.oracle import REPORT_ORDER
    qs, oracle = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for key in keys or list(qs):
        t0 = time.time()
        try:
            sdf = qs[key](spark, sf_dir)
            scols = sdf.columns
            stypes = {f.name: duck_type(f.dataType) for f in sdf.schema.fields}
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            out[key] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            if verbose:
                print(key, out[key], flush=True)
            continue
        ts = time.time() - t0
        if key not in oracle:
            out[key] = f"rows-only {len(srows)}"
            if verbose:
                print(f"{key:28s} {out[key]}  ({ts:.1f}s)", flush=True)
            continue
        try:
            res = con.execute(oracle[key])
            dcols = [d[0] for d in res.description]
            dtypes = {d[0]: str(d[1]) for d in res.description}
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            out[key] = f"DUCK ERROR {type(e).__name__}: {str(e)[:300]}"
            if verbose:
                print(key, out[key], flush=True)
            continue
        type_diff = {c: (stypes[c], dtypes.get(c)) for c in scols if stypes[c] != dtypes.get(c)}
        if sorted(scols) != sorted(dcols):
            out[key] = f"COLUMNS {scols} vs {dcols}"
        elif type_diff:
            out[key] = f"TYPES {type_diff}"
        else:
            order = [dcols.index(c) for c in scols]
            drows = [tuple(r[i] for i in order) for r in drows]
            a, b = rows_key(srows), rows_key(drows)
            if len(a) != len(b):
                out[key] = f"ROWCOUNT spark={len(a)} duck={len(b)}"
            elif a != b:
                diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
                out[key] = f"VALUES differ ({sum(x != y for x, y in zip(a, b))} rows) e.g. {diff}"
            elif key in REPORT_ORDER and [[_norm(v) for v in r] for r in srows] != [[_norm(v) for v in r] for r in drows]:
                out[key] = "ORDER of rows differs"
            else:
                out[key] = f"OK {len(a)}"
        if verbose:
            print(f"{key:28s} {out[key][:400]}  ({ts:.1f}s)", flush=True)
    return out


def main():
    from spendlens.session import get_spark
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or None
    spark = get_spark("local[8]", 8)
    res = compare(spark, sf_dir, keys)
    bad = {k: v for k, v in res.items() if not (v.startswith("OK") or v.startswith("rows-only"))}
    print(f"\n{len(res) - len(bad)}/{len(res)} ok")
    for k, v in bad.items():
        print("  FAIL", k, v[:300])


if __name__ == "__main__":
    main()
