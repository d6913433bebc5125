"""Run registered queries and compare them with their oracle SQL in DuckDB."""

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return int(value)
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.6g}" if value != int(value) or abs(value) > 1e15 else str(int(value))
    if isinstance(value, int):
        return str(value)
    if type(value).__name__ == "Decimal":
        return normal(float(value))
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, normal(v)) for k, v in value.items()))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


def check(spark, con, sf_dir, name, run, sql):
    started = time.perf_counter()
    df = run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.perf_counter() - started
    rows, columns = rows_of(df.columns, got)
    if sql is None:
        return ("rows-only" if rows else "EMPTY"), took, len(rows), ""
    result = con.execute(sql)
    want_columns = [d[0] for d in result.description]
    want, want_columns = rows_of(want_columns, result.fetchall())
    if columns != want_columns:
        return "COLUMNS", took, len(rows), f"{columns} != {want_columns}"
    if rows != want:
        got_set, want_set = set(rows), set(want)
        missing = [r for r in want if r not in got_set][:3]
        extra = [r for r in rows if r not in want_set][:3]
        return "VALUES", took, len(rows), f"{len(rows)} vs {len(want)} rows; oracle {missing}; spark {extra}"
    return ("ok" if rows else "EMPTY"), took, len(rows), ""


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf_dir = argv[0]
    wanted = argv[1:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            status, took, count, note = check(spark, con, sf_dir, name, run, oracle.get(name))
        except Exception as error:  # report and go on with the next query
            status, took, count, note = "ERROR", 0.0, 0, str(error)[:1500]
        if status not in ("ok", "rows-only"):
            bad += 1
        print(f"{status:10s} {took:6.2f}s {count:7d} {name} {note}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
