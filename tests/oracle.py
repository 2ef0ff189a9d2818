"""Compare queries() with oracle_sql() on one folder of tables: python tests/oracle.py FOLDER [NAME...]"""

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        src = p if os.path.isfile(p) else f"{p}/*.parquet"
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{src}'")
    return con


def plain(v):
    import math

    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if hasattr(v, "tzinfo") and getattr(v, "tzinfo", None):
        return v.replace(tzinfo=None)
    return v


def compare(spark, con, name, folder, entry):
    from collections import Counter

    df = entry.queries()[name](spark, folder)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return sum(got.values()), None, "rows only"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return sum(got.values()), None, f"columns differ: {cols} {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    if got == want:
        return sum(got.values()), sum(want.values()), "ok"
    return sum(got.values()), sum(want.values()), f"DIFFERS: only here {list((got - want).items())[:2]}; only there {list((want - got).items())[:2]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "file:///tmp/shared").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    folder, names = sys.argv[1], sys.argv[2:] or list(entry.queries())
    con = connect(folder)
    for name in names:
        t = time.time()
        try:
            n, m, said = compare(spark, con, name, folder, entry)
        except Exception as e:
            n, m, said = None, None, "FAILED " + str(e)[:700]
        print(f"{name}: {n} {m} {said[:600]} {time.time() - t:.1f}s", flush=True)
