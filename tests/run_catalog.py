"""Run registered queries against their SQL: python tests/run_catalog.py [sf_dir] [name part ...]"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

import __spark_entry__ as entry
from compare import connect, difference

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
parts = sys.argv[2:]
spark = (
    SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
    .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
con = connect(sf)
sqls = entry.oracle_sql()
bad = 0
for name, fn in entry.queries().items():
    if parts and not any(p in name for p in parts):
        continue
    t = time.time()
    try:
        if name in sqls:
            d = difference(fn(spark, sf), con, sqls[name])
        else:
            d = "" if fn(spark, sf).count() else "no rows"
            name += " (rows only)"
    except Exception as e:
        d = f"{type(e).__name__}: {str(e)[:700]}"
        if os.environ.get("TRACE"):
            traceback.print_exc()
    bad += bool(d)
    print(f"{'FAIL' if d else 'ok  '} {time.time() - t:6.2f}s {name} {d}", flush=True)
print("failures:", bad)
