"""Run registered queries on Spark and their SQL on DuckDB, and compare row counts, types and values.

    python -m tests.compare [scale factor] [name ...]
"""

import math
import sys
import time
import traceback

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP"}


def duck(directory):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{directory}/{t}.parquet'")
    return con


def order_key(row):
    return tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)


def differences(df, con, sql):
    rel = con.sql(sql)
    found = []
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return [f"columns {names} != {sorted(rel.columns)}"]
    types = dict(zip(rel.columns, map(str, rel.types)))
    for f in df.schema:
        kind = KINDS.get(f.dataType.simpleString(), f.dataType.simpleString())
        if kind != types[f.name]:
            found.append(f"type of {f.name}: {kind} != {types[f.name]}")
    ours = sorted((tuple(r[n] for n in names) for r in df.collect()), key=order_key)
    theirs = sorted(rel.select(*[f'"{n}"' for n in names]).fetchall(), key=order_key)
    if len(ours) != len(theirs):
        return [*found, f"rows {len(ours)} != {len(theirs)}"]
    for a, b in zip(ours, theirs):
        if a != b and not all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y)) for x, y in zip(a, b)):
            found.append(f"{a} != {b}")
            if len(found) > 3:
                break
    return found


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    scale = argv[0] if argv else "0.01"
    directory = f"/root/testdata/sf{scale}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(directory)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in argv[1:] or queries:
        start = time.time()
        try:
            found = differences(queries[name](spark, directory), con, sql[name]) if name in sql else ["no SQL"]
        except Exception as e:
            found = [f"{type(e).__name__}: {str(e)[:600]}"]
            if len(argv) > 1:
                traceback.print_exc()
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok'} {name} {time.time() - start:.2f}s", *found, sep="\n    " if found else " ")
    print("failures:", bad, "of", len(argv[1:] or queries))


if __name__ == "__main__":
    main(sys.argv[1:])
