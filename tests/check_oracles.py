"""Runs every registered query next to its SQL and compares the rows.

Usage: python tests/check_oracles.py [sf_dir] [query ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from eventloom.session import build_session  # noqa: E402


def expected(sf_dir: str, sql: str):
    db = duckdb.connect()
    for name in os.listdir(sf_dir):
        db.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return db.execute(sql).to_arrow_table().to_pandas()


def canonical(frame):
    """Rows as comparable tuples, columns by name."""
    def cell(value):
        if value is None or value != value:
            return None
        if isinstance(value, float):
            return round(value, 6)
        if hasattr(value, "item"):
            value = value.item()
            return round(value, 6) if isinstance(value, float) else value
        return value

    columns = sorted(frame.columns)
    rows = [tuple(cell(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False)]
    return columns, sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


def compare(spark, name: str, sf_dir: str) -> tuple[bool, str]:
    got = canonical(contract.queries()[name](spark, sf_dir).toPandas())
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return True, f"{len(got[1])} rows, no SQL"
    want = canonical(expected(sf_dir, sql))
    if got[0] != want[0]:
        return False, f"columns {got[0]} vs {want[0]}"
    if len(got[1]) != len(want[1]):
        return False, f"{len(got[1])} rows vs {len(want[1])}"
    for a, b in zip(got[1], want[1], strict=True):
        if a != b:
            return False, f"first difference\n  got  {a}\n  want {b}"
    return True, f"{len(got[1])} rows"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(contract.queries())
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names:
        started = time.time()
        try:
            ok, note = compare(spark, name, sf_dir)
        except Exception as problem:  # noqa: BLE001
            ok, note = False, "".join(traceback.format_exception_only(problem))[:900]
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:26s} {time.time() - started:6.1f}s {note}", flush=True)
    print(f"{len(names) - bad} of {len(names)} match")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
