"""The operators run where the workers cannot import the package."""
import os
import subprocess
import sys

CODE = """
import importlib.util
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .getOrCreate())
spec = importlib.util.spec_from_file_location("entry_by_path", ENTRY)
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
for name, query in entry.queries().items():
    if name.split("_")[0] in ("op1", "op3", "op5", "op7", "op9"):
        print("ROWS", name, query(spark, "/root/testdata/sf0.001").count())
"""


def test_workers_without_the_package():
    entry = os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "__spark_entry__.py")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", f"ENTRY = {entry!r}\n{CODE}"], cwd="/", env=env, capture_output=True, text=True,
                          timeout=600)
    rows = [line.split() for line in done.stdout.splitlines() if line.startswith("ROWS")]
    assert len(rows) == 5 and all(int(n) > 0 for _, _, n in rows), done.stderr[-3000:]
