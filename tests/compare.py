"""Run the registered queries next to their SQL: python tests/compare.py [sf_dir] [query ...]"""

from __future__ import annotations

import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def type_difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """Columns whose declared types differ."""
    want = {name: str(kind) for name, kind, *_ in con.execute(f"DESCRIBE {sql}").fetchall()}
    got = {name: SPARK_TYPES.get(kind, kind) for name, kind in df.dtypes}
    wrong = [f"{n} {got[n]} <> {want.get(n)}" for n in got if got[n] != want.get(n)]
    return "types: " + ", ".join(wrong) if wrong else None


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(0.0 if row[i] == 0 else row[i] for i in order) for row in rows), key=repr)


def spark_result(df) -> tuple[list[str], list[tuple]]:
    return rows_of(df.columns, df.collect())


def sql_result(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    result = con.execute(sql)
    return rows_of([d[0] for d in result.description], result.fetchall())


def difference(got, want) -> str | None:
    if got[0] != want[0]:
        return f"columns {got[0]} <> {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows, SQL has {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"first difference {str(a)[:200]} <> {str(b)[:200]}"
        if [type(x) for x in a] != [type(x) for x in b]:
            return f"types {[type(x) for x in a]} <> {[type(x) for x in b]}"
    return None


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (SparkSession.builder.master(f"local[{os.environ.get('CORES', 8)}]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-twinsift-")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(folder), entry.oracle_sql()
    failed = 0
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        try:
            start = time.time()
            df = query(spark, folder)
            got = spark_result(df)
            taken = time.time() - start
            problem = "no SQL" if name not in sql else (
                difference(got, sql_result(con, sql[name])) or type_difference(df, con, sql[name]) or "ok")
            count = len(got[1])
        except Exception as error:  # report and go on
            problem, taken, count = f"ERROR {str(error)[:600]}", 0.0, 0
        failed += problem not in ("ok", "no SQL")
        print(f"{name:24s} {count:7d} rows {taken:6.1f} s  {problem}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
