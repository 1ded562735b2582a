"""The entry module imports before any Spark session exists, as a driver does."""

import subprocess
import sys
from pathlib import Path


def test_import_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=True)
