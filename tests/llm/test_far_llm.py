import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("ROWS", *[e.queries()[n](s, "/root/testdata/sf0.001").count() for n in ("p7_ids", "p8_found", "p9_found")])
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Executors that cannot import the package get its classes and functions by value."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    rows = [x for x in out.stdout.splitlines() if x.startswith("ROWS")]
    assert rows and all(int(n) > 0 for n in rows[0].split()[1:]), out.stderr[-2000:]
