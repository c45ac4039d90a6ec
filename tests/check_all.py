"""Compare all queries with their SQL at a scale and print one line each."""

import os
import sys
import tempfile
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tests.oracle import connect, difference  # noqa: E402


def main():
    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    only = sys.argv[2:]
    shared = tempfile.TemporaryDirectory(prefix="check-all-")
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", shared.name).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    for name, run in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            frame = run(spark, sf_dir)
            if name in oracles:
                problem = difference(frame, con, oracles[name])
            else:
                problem = f"rows only: {frame.count()}"
        except Exception as error:
            problem = "ERROR " + str(error)[:700]
            if only:
                traceback.print_exc()
        print(f"{name:32s} {time.time() - start:6.1f}s  {problem or 'ok'}", flush=True)


main()
