"""Compare registered queries with their SQL on the same tables: ``python -m tests.oracle [sf] [name ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

DATA = os.environ.get("DOCLAKE_TESTDATA", "/root/testdata")


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _canonical(frame: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    columns = sorted(frame.columns)

    def cell(value):
        if value is None or (isinstance(value, float) and value != value) or value is pd.NaT or value is pd.NA:
            return None
        if hasattr(value, "item"):
            value = value.item()
        return value

    rows = [tuple(cell(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False, name=None)]
    return columns, sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def frame_of(df) -> pd.DataFrame:
    """The rows of a Spark DataFrame; whole numbers stay whole where a column has nulls."""
    return df.toArrow().to_pandas(integer_object_nulls=True)


def compare(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """A description of the first difference, or None."""
    left_columns, left = _canonical(spark_frame)
    right_columns, right = _canonical(sql_frame)
    if left_columns != right_columns:
        return f"columns {left_columns} != {right_columns}"
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)}"
    for a, b in zip(left, right):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{str(a)[:400]}\n   != {str(b)[:400]}"
    return None


def check(spark, con, name: str, sf: str) -> str | None:
    import __spark_entry__ as entry

    frame = frame_of(entry.queries()[name](spark, sf))
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if len(frame.columns) else "no columns"
    return compare(frame, con.sql(sql).df())


def types(spark_df, con, sql: str) -> dict[str, tuple[str, str]]:
    """Columns whose types are not counterparts."""
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    relation = con.sql(sql)
    have = dict(zip(relation.columns, map(str, relation.types)))
    return {n: (t, have.get(n)) for n, t in spark_df.dtypes if pairs.get(t, t) != have.get(n)}


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from doclake.session import build_session

    args = sys.argv[1:]
    sf = f"{DATA}/{args.pop(0) if args and args[0].startswith('sf') else 'sf0.01'}"
    spark = build_session("oracle")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = []
    for name in args or entry.queries():
        begin = time.time()
        try:
            problem = check(spark, con, name, sf)
            sql = entry.oracle_sql().get(name)
            if problem is None and sql:
                problem = str(types(entry.queries()[name](spark, sf), con, sql) or "") or None
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        mark = "rows" if name not in entry.oracle_sql() else "ok"
        print(f"{'FAIL' if problem else mark:5}{name:24}{time.time() - begin:7.2f}s  {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
