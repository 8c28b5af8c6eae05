"""python tests/check.py SF [name-prefix ...]: compare registered queries with DuckDB."""

import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import __spark_entry__ as entry
from oracle import compare, duck
from pyspark.sql import SparkSession

sf = f"/root/testdata/sf{sys.argv[1]}"
spark = (
    SparkSession.builder.master("local[8]")
    .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    .config("spark.sql.shuffle.partitions", "8")
    .config("spark.driver.memory", "12g")
    .config("spark.sql.session.timeZone", "UTC")
    .getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
if not spark.conf.get("spark.checkpoint.dir", None):
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="shared-"))
con = duck(sf)
oracles = entry.oracle_sql()
bad = 0
for name, fn in entry.queries().items():
    if len(sys.argv) > 2 and not any(name.startswith(p) for p in sys.argv[2:]):
        continue
    t = time.time()
    try:
        df = fn(spark, sf)
        if name in oracles:
            err, n = compare(df, con, oracles[name])
        else:
            err, n = "", len(df.collect())
    except Exception as e:
        err, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
    bad += bool(err)
    state = "FAIL" if err else "ok  "
    note = "" if name in oracles else "(rows only)"
    print(f"{state} {name:32s} rows={n:<7d} {time.time() - t:6.2f}s {note} {err}", flush=True)
print("failures", bad)
