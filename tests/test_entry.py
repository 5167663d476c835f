import os
import subprocess
import sys

import pytest

from cohortloom.sources.tables import shared_folder

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.modules["regex"] = None
sys.path.insert(0, {root!r})
import __spark_entry__ as e
print("NAMES", len(e.queries()), len(e.oracle_sql()), "p1_found" in e.queries(), "p9_found" in e.queries())
"""


def test_core_queries_without_the_packages_of_the_rest():
    """A missing package costs the subpackage's queries only."""
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], capture_output=True, text=True, timeout=120)
    names = next(x for x in out.stdout.splitlines() if x.startswith("NAMES")).split()
    assert int(names[1]) > 150 and int(names[2]) > 120 and names[3:] == ["True", "False"]


class _Cluster:
    """A session of a cluster without a checkpoint folder."""

    class conf:
        get = staticmethod(lambda name, default=None: default)

    class sparkContext:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)


def test_no_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(_Cluster)
