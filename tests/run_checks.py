"""Check registered queries against their oracle: python tests/run_checks.py [folder] [name prefix …]"""

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tests.oracle_check import connect, differences  # noqa: E402


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("HOT_ROWS"):
        spark.conf.set("spark.attestry.hotGroupRows", os.environ["HOT_ROWS"])
    con = connect(folder)
    bad = 0
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        t = time.time()
        try:
            if name in oracles:
                problem = differences(spark, con, folder, fn, oracles[name])
            else:
                n = len(fn(spark, folder).collect())
                problem = None if n else "no rows"
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        took = time.time() - t
        if problem:
            bad += 1
        print(f"{'FAIL' if problem else 'ok  '} {took:6.2f}s {name}{'' if name in oracles else ' (rows only)'}"
              + (f"\n  {problem}" if problem else ""), flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
