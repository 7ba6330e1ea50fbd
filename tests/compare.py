"""Runs registered queries and their checking SQL and compares the results."""

from __future__ import annotations

import decimal
import glob
import logging
import os
import sys
import time

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def canonical(value) -> str:
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return "\\N"
    if isinstance(value, (bool,)) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, decimal.Decimal):
        value = int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float) or type(value).__name__.startswith("float"):
        return repr(round(float(value), 9))
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    return str(value)


def rows_of(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    columns = sorted(frame.columns)
    return sorted(zip(*[[canonical(v) for v in frame[c].astype(object)] for c in columns])) if len(frame) else []


def kinds_of(frame: pd.DataFrame) -> dict[str, str]:
    return {c: frame[c].dtype.kind for c in frame.columns}


def difference(mine: pd.DataFrame, oracle: pd.DataFrame) -> str | None:
    if sorted(mine.columns) != sorted(oracle.columns):
        return f"columns {sorted(mine.columns)} / {sorted(oracle.columns)}"
    if len(mine) != len(oracle):
        return f"rows {len(mine)} / {len(oracle)}"
    left, right = rows_of(mine), rows_of(oracle)
    if left != right:
        only_left = sorted(set(left) - set(right))[:3]
        only_right = sorted(set(right) - set(left))[:3]
        return f"values {only_left} / {only_right}"
    return None


def main(folder: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    logging.disable(logging.CRITICAL)
    connection, oracles = connect(folder), entry.oracle_sql()
    failed = 0
    for name, build in entry.queries().items():
        if names and not any(n in name for n in names):
            continue
        started = time.time()
        try:
            mine = build(spark, folder)
            types = dict(mine.dtypes)
            mine = mine.toPandas()
            problem = None
            if name in oracles:
                relation = connection.sql(oracles[name])
                oracle_types = dict(zip(relation.columns, map(str, relation.types)))
                problem = difference(mine, relation.df())
                widths = {
                    c: (types[c], oracle_types.get(c))
                    for c in types
                    if {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
                        "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}.get(types[c]) != oracle_types.get(c)
                }
                if widths:
                    problem = f"{problem or ''} types {widths}"
            status = problem or ("same" if name in oracles else "rows only")
        except Exception as error:  # reported per query
            problem = status = f"{type(error).__name__}: {str(error)[:300]}"
        failed += bool(problem)
        size = len(mine) if not problem or "types" in problem else "-"
        if problem or os.environ.get("VERBOSE"):
            print(f"{name:36} {size!s:>8} {time.time() - started:6.2f}s {status}", flush=True)
    print("failed", failed, "of", len(entry.queries()))
    return failed


if __name__ == "__main__":
    sys.path.insert(0, os.getcwd())
    sys.exit(main(sys.argv[1], sys.argv[2:]))
