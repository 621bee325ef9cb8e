"""The contract module imports with neither Spark's jars nor a session."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = """
import builtins, pathlib
def no_jars(self, pattern, f=pathlib.Path.glob):
    assert "jar" not in pattern
    return f(self, pattern)
pathlib.Path.glob = no_jars
import __spark_entry__ as e
assert e.queries() and e.oracle_sql()
from pyspark import SparkContext
assert SparkContext._active_spark_context is None
"""


def test_import_needs_no_session():
    env = os.environ | {"PATH": "/nonexistent", "JAVA_HOME": "/nonexistent"}
    subprocess.run([sys.executable, "-c", PROBE], cwd=ROOT, env=env, check=True, timeout=120)
