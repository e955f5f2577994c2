"""Run registered queries next to their oracle statements and compare the rows."""

from __future__ import annotations

import decimal
import math
import time

from pyspark.sql import SparkSession

from wtel.fixtures import registry
from wtel.fixtures.views import BASE_TABLES


def session(cpus: int = 8, **conf: str) -> SparkSession:
    import os
    import tempfile

    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.sparkContext.setCheckpointDir(
            tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
        )
    return spark


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value: object) -> object:
    if isinstance(value, decimal.Decimal):
        return int(value) if value == int(value) else float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (int(value) if value == int(value) else round(value, 6))
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(names: list[str], rows: list) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows),
        key=lambda r: tuple((v is not None, str(type(v)), str(v)) for v in r),
    )


def compare(spark: SparkSession, con, sf_dir: str, key: str) -> dict:
    """Row counts, times and the first difference of one query; ``ok`` if the rows are equal."""
    started = time.time()
    df = registry.QUERIES[key](spark, sf_dir)
    got_names = df.columns
    got = _rows(got_names, df.collect())
    took = time.time() - started
    result = {"key": key, "rows": len(got), "sec": round(took, 2)}
    if key not in registry.STATEMENTS:
        return {**result, "ok": len(got) > 0, "oracle": False}
    started = time.time()
    cur = con.execute(registry.STATEMENTS[key])
    want_names = [c[0] for c in cur.description]
    want = _rows(want_names, cur.fetchall())
    result["oracle_sec"] = round(time.time() - started, 2)
    if sorted(got_names) != sorted(want_names):
        return {**result, "ok": False, "diff": (sorted(got_names), sorted(want_names))}
    if got != want:
        only_got = sorted(set(got) - set(want), key=str)[:2]
        only_want = sorted(set(want) - set(got), key=str)[:2]
        return {**result, "ok": False, "want_rows": len(want), "diff": (only_got, only_want)}
    return {**result, "ok": True}


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    keys = [k for k in registry.QUERIES if not argv[1:] or any(k.startswith(p) for p in argv[1:])]
    spark, con = session(), connect(sf_dir)
    bad = 0
    for key in keys:
        try:
            r = compare(spark, con, sf_dir, key)
        except Exception as e:  # report and go on to the next query
            r = {"key": key, "ok": False, "error": f"{type(e).__name__}: {str(e)[:600]}"}
        bad += not r["ok"]
        print("ok  " if r["ok"] else "FAIL", r, flush=True)
    print(f"{len(keys) - bad} of {len(keys)} equal")
    return bad


if __name__ == "__main__":
    import sys

    sys.exit(main(sys.argv[1:]) > 0)
