"""Run registered queries and their SQL side by side."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(root: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{root}/{table}.parquet')"
        )
    return connection


def _key(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)):
        return (1, 0.0 if value == 0 else value) if not math.isnan(value) else (2, "nan")
    return (3, str(value))


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_key(row[i]) for i in order) for row in rows)


def differences(spark_df, cursor) -> list[str]:
    """Readable differences between a DataFrame and a DuckDB result."""
    expected = cursor.fetchall()
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(names)}"]
    types = dict(zip(names, [str(d[1]) for d in cursor.description], strict=True))
    kinds = {
        "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
        "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "DATE": "date",
    }
    found = [
        f"type of {name}: {kind} != {types[name]}"
        for name, kind in spark_df.dtypes
        if kinds.get(types[name], types[name]) != kind
    ]
    got = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    want = _rows(names, expected)
    if len(got) != len(want):
        found.append(f"{len(got)} rows != {len(want)}")
    bad = [(g, w) for g, w in zip(got, want, strict=False) if g != w]
    if bad:
        columns = sorted(names)
        g, w = bad[0]
        found.append(
            f"{len(bad)} rows differ, first: "
            + "; ".join(f"{c}: {x[1]!r} != {y[1]!r}" for c, x, y in zip(columns, g, w, strict=True) if x != y)
        )
    return found


def main(root: str, names: list[str]) -> int:
    import __spark_entry__ as contract
    from rentlens import build_session

    spark = build_session(
        "compare", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(root)
    failed = 0
    queries, statements = contract.queries(), contract.oracle_sql()
    for name in names or queries:
        start = time.time()
        df = queries[name](spark, root)
        if name not in statements:
            print(f"rows  {name} {df.count()} {time.time() - start:.1f}s", flush=True)
            continue
        problems = differences(df, connection.execute(statements[name]))
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '}  {name} {time.time() - start:.1f}s", flush=True)
        for problem in problems:
            print("      ", problem[:1500], flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
