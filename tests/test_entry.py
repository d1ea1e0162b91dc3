"""The entry module as the driver finds it."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_imports_need_no_session():
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q))"], cwd=REPO, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout) > 100
