"""Runs registered queries beside their DuckDB SQL: ``python -m tests.oracle SF_DIR [NAME...]``."""

from __future__ import annotations

import os
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "is_integer") or type(v).__name__ == "Decimal":
        return f"{float(v):.5g}" if v == v else "nan"
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "hour") else v.isoformat()
    return str(v)


def connect(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    c.execute("SET threads=4; SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, f, sql: str | None) -> str:
    """Empty if both sides agree, else what differs."""
    df = f(spark, sf_dir)
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return ""
    rel = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in rel.description], rel.fetchall())
    if cols != want_cols:
        return f"columns {cols} / {want_cols}"
    if got != want:
        a, b = [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3]
        return f"{len(got)} / {len(want)} rows; only here {a}; only there {b}"
    return "" if got else "no rows"


def main(sf_dir: str, names: list[str]) -> int:
    from pyspark.sql import SparkSession

    from lorespark import catalog

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name, f in catalog.queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            why = compare(spark, con, sf_dir, f, catalog.oracle_sql().get(name))
        except Exception as e:
            why = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(why)
        print(f"{'BAD ' if why else 'ok  '}{name} {time.time() - began:.1f} s {why}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1], sys.argv[2:])))
