"""Compare registered queries with their SQL: ``python tests/oracle.py [sf] [name …]``."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT",
}


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty if both give the same columns, types and rows in any order."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    rows = result.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} against {sorted(names)}"]
    found = []
    for field in spark_df.schema.fields:
        mine = KINDS.get(field.dataType.simpleString(), field.dataType.simpleString())
        if mine != kinds[field.name]:
            found.append(f"type of {field.name}: {mine} against {kinds[field.name]}")
    order = sorted(names)
    spots = [names.index(n) for n in order]
    want = sorted(tuple(_cell(r[i]) for i in spots) for r in rows)
    got = sorted(tuple(_cell(r[n]) for n in order) for r in spark_df.collect())
    if len(want) != len(got):
        found.append(f"rows {len(got)} against {len(want)}")
    if want != got:
        found.append(f"only in Spark: {sorted(set(got) - set(want))[:3]}")
        found.append(f"only in SQL: {sorted(set(want) - set(got))[:3]}")
    return found


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(args: list[str]) -> int:
    import __spark_entry__ as contract

    sf = args[0] if args else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), connect(sf_dir)
    bad = 0
    for name, query in contract.queries().items():
        if args[1:] and not any(a in name for a in args[1:]):
            continue
        start = time.time()
        try:
            sql = contract.oracle_sql().get(name)
            df = query(spark, sf_dir)
            if sql is None:
                print(f"ROWS {df.count():6d} {name} {time.time() - start:.1f}s", flush=True)
                continue
            found = differences(df, con, sql)
        except Exception as error:  # report and go on with the next query
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(found)
        print("FAIL" if found else "OK  ", name, f"{time.time() - start:.1f}s", flush=True)
        for line in found:
            print("      ", line[:900], flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
