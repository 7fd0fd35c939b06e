"""Compare every registered query with its SQL in DuckDB: python -m tests.compare [sf_dir] [name ...]"""

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        path = Path(sf_dir) / f"{table}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return (
        [columns[i] for i in order],
        sorted(tuple(normal(row[i]) for i in order) for row in rows),
    )


def spark_rows(df):
    return rows_of(df.columns, [tuple(row) for row in df.collect()])


def sql_rows(con, sql):
    cursor = con.execute(sql)
    return rows_of([column[0] for column in cursor.description], cursor.fetchall())


def difference(df, con, sql):
    """None when equal, else what differs first."""
    columns, got = spark_rows(df)
    expected_columns, expected = sql_rows(con, sql)
    if columns != expected_columns:
        return f"columns {columns} != {expected_columns}"
    if got != expected:
        only_got = sorted(set(got) - set(expected))[:2]
        only_expected = sorted(set(expected) - set(got))[:2]
        return f"{len(got)} rows vs {len(expected)}; extra {only_got}; missing {only_expected}"
    return None


def main(sf_dir="/root/testdata/sf0.01", *names):
    import __spark_entry__ as entry
    from tests.session import session

    spark, con, oracles = session(), connect(sf_dir), entry.oracle_sql()
    failed = 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracles:
                problem = difference(df, con, oracles[name])
                note = f"{df.count()} rows"
            else:
                problem, note = None, f"{df.count()} rows, no SQL"
        except Exception as error:  # report and go on with the next query
            problem, note = f"{type(error).__name__}: {str(error)[:600]}", ""
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - started:.1f}s"
              f" {problem or note}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
