"""Run the registered queries next to their SQL.

    python tests/check_oracles.py /root/testdata/sf0.01 [name ...]
"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402

from larder.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def compare(spark, con, folder, name, query, sql):
    """Text of the difference, or None; and the seconds of both."""
    started = time.perf_counter()
    df = query(spark, folder)
    ours = plain([tuple(r) for r in df.collect()], df.columns)
    spark_seconds = time.perf_counter() - started
    started = time.perf_counter()
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = plain(result.fetchall(), columns)
    sql_seconds = time.perf_counter() - started
    difference = None
    if sorted(columns) != sorted(df.columns):
        difference = f"columns {sorted(df.columns)} against {sorted(columns)}"
    elif ours != theirs:
        only = sorted(set(ours) - set(theirs))[:3], sorted(set(theirs) - set(ours))[:3]
        difference = f"{len(ours)} rows against {len(theirs)}\n  ours {only[0]}\n  sql  {only[1]}"
    return difference, len(ours), spark_seconds, sql_seconds


def main():
    folder, names = sys.argv[1], sys.argv[2:]
    spark, con, sql = local_session(8), duck(folder), oracle_sql()
    bad = 0
    for name, query in queries().items():
        if names and name not in names or name not in sql:
            continue
        try:
            difference, n, ours, theirs = compare(spark, con, folder, name, query, sql[name])
        except Exception as failure:  # noqa: BLE001
            difference, n, ours, theirs = f"failed: {str(failure)[:800]}", 0, 0, 0
        bad += difference is not None
        print(f"## {name}: {'ok' if difference is None else difference[:2000]} "
              f"({n} rows, {ours:.1f} s, sql {theirs:.1f} s)", flush=True)
    print(f"## differing: {bad}")


if __name__ == "__main__":
    main()
