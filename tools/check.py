"""Compare every registered query with its SQL twin and print the differences.

Usage: python tools/check.py [folder] [query ...]
"""

from __future__ import annotations

import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from eventloom.plans.catalogue import REGISTERED  # noqa: E402
from eventloom.plans.oracles import ORACLES  # noqa: E402
from eventloom.session import local_session  # noqa: E402

TABLES = "region nation customer events".split()


def rows_of(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    plain = frame.astype(object).where(frame.notna(), None)
    return sorted(plain.itertuples(index=False, name=None), key=repr)


def compare(spark, folder: str, name: str) -> str:
    """'' when equal, otherwise what differs."""
    ours = REGISTERED[name](spark, folder).toPandas()
    if name not in ORACLES:
        return "" if len(ours) else "no rows"
    with duckdb.connect() as db:
        for table in TABLES:
            db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
        theirs = db.execute(ORACLES[name]).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} / {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    if not len(ours):
        return "both empty"
    for a, b in zip(rows_of(ours), rows_of(theirs), strict=True):
        if a != b:
            return f"first difference {a} / {b}"
    types = [
        f"{c}: {ours[c].dtype} / {theirs[c].dtype}"
        for c in ours.columns
        if ours[c].dtype.kind != theirs[c].dtype.kind
    ]
    return f"types {types}" if types else ""


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(REGISTERED)
    spark = local_session()
    failures = 0
    for name in names:
        started = time.time()
        try:
            problem = compare(spark, folder, name)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failures += bool(problem)
        print(f"{'FAIL' if problem else 'ok':4} {name} {time.time() - started:.1f}s {problem}")
    missing = [n for n in names if n not in ORACLES]
    print(f"{len(names)} queries, {failures} differ, without SQL: {missing}")
    spark.stop()
    return failures


if __name__ == "__main__":
    raise SystemExit(main())
