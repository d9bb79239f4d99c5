"""The contract on a session that the library did not build, in a process of its own."""

import subprocess
import sys

SCRIPT = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__ as contract
assert contract.entry(spark).count() > 0
one = {}
for name, build in contract.queries().items():
    one.setdefault(name.rstrip("0123456789").split("_")[0].rstrip("0123456789"), (name, build))
for name, build in one.values():
    build(spark, contract.SMALL).count()
print("DONE", len(one))
"""


def test_runs_on_a_plain_session():
    done = subprocess.run([sys.executable, "-c", SCRIPT], capture_output=True, text=True, timeout=900)
    assert done.returncode == 0 and "DONE" in done.stdout, done.stderr[-2000:]
