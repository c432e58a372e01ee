"""Run catalogue queries and their SQL side by side and report differences."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    return connection


def _cells(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    columns = []
    for name in frame.columns:
        values = frame[name]
        if pd.api.types.is_datetime64_any_dtype(values) or values.map(
                lambda v: hasattr(v, "isoformat")).any():
            columns.append([None if pd.isna(v) else str(pd.Timestamp(v)) for v in values])
        else:
            plain = [None if v is None or v is pd.NA or v != v else
                     (float(v) if isinstance(v, float) else v) for v in values]
            if None in plain:  # pandas turns whole numbers beside nulls into floats, on one side
                plain = [float(v) if isinstance(v, (int, np.integer)) and not isinstance(v, bool)
                         else v for v in plain]
            columns.append(plain)
    return sorted(zip(*columns), key=repr)


def differences(ours: pd.DataFrame, theirs: pd.DataFrame) -> str:
    """Empty when both hold the same rows under the same names."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} against {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    left, right = _cells(ours), _cells(theirs)
    wrong = [(a, b) for a, b in zip(left, right) if a != b or repr(a) != repr(b)]
    if not wrong:
        return ""
    return f"{len(wrong)} of {len(left)} rows differ, first {wrong[0]}"


def main(folder: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from waitwright.session import local_session

    spark, connection = local_session(8), connect(folder)
    queries, statements, failed = entry.queries(), entry.oracle_sql(), 0
    for name in names or list(queries):
        start = time.time()
        try:
            ours = queries[name](spark, folder).toPandas()
            took = time.time() - start
            if name in statements:
                gap = differences(ours, connection.execute(statements[name]).df())
            else:
                gap = "" if len(ours) else "no rows"
        except Exception as error:  # report and go on
            took, gap, ours = time.time() - start, f"{type(error).__name__}: {str(error)[:600]}", ()
        failed += bool(gap)
        kind = "sql " if name in statements else "rows"
        print(f"{'FAIL' if gap else 'ok  '} {kind} {name:26s} {len(ours):7d} {took:6.2f}s {gap}",
              flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
