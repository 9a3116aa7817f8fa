"""Runs registered queries beside their SQL in DuckDB: python tests/oracle.py [SF_DIR] [NAME...]"""

import datetime
import decimal
import sys
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(x):
    if isinstance(x, decimal.Decimal):
        return float(x) if x % 1 else int(x)
    if isinstance(x, float):
        return "nan" if x != x else int(x) if x % 1 == 0 else round(x, 9)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


def compare(spark, con, query, sql, sf_dir):
    """None if both give the same rows, else what differs."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    theirs = rows_of([d[0] for d in found.description], found.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} and {theirs[0]}"
    if mine[1] != theirs[1]:
        odd = [(a, b) for a, b in zip(mine[1], theirs[1], strict=False) if a != b][:1]
        return f"{len(mine[1])} and {len(theirs[1])} rows, first that differ: {odd}"
    return None


if __name__ == "__main__":
    import time

    import __spark_entry__
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = connect(sf_dir), __spark_entry__.queries(), __spark_entry__.oracle_sql()
    for name in sys.argv[2:] or sorted(sql):
        began = time.time()
        try:
            said = compare(spark, con, queries[name], sql[name], sf_dir)
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:400]}"
        print(f"{name:24} {time.time() - began:5.1f}s {'ok' if said is None else said}", flush=True)
