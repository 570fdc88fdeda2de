"""Side-by-side check of a registered query and its SQL."""

import datetime
import decimal
import math

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
# DuckDB type -> Spark type that holds the same values.
SAME_TYPE = {
    "VARCHAR": "string",
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return repr(value)


def sorted_rows(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def differences(result: DataFrame, db: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty when names, types and rows agree."""
    found = []
    expected = db.sql(sql)
    ours = {name: kind for name, kind in result.dtypes}
    theirs = {name: SAME_TYPE.get(str(kind), str(kind)) for name, kind in zip(expected.columns, expected.types)}
    if ours != theirs:
        found.append(f"schema: {sorted(ours.items() ^ theirs.items())}")
    left = sorted_rows(result.columns, result.collect())
    right = sorted_rows(expected.columns, expected.fetchall())
    if len(left) != len(right):
        found.append(f"rows: {len(left)} against {len(right)}")
    if left != right:
        only_left = [r for r in left if r not in set(right)][:2]
        only_right = [r for r in right if r not in set(left)][:2]
        found.append(f"values: {only_left} against {only_right}")
    return found
