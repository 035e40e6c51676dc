"""The contract module, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names(folder):
    code = "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') or n == 'pipeline' for n in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env=env, capture_output=True, text=True, check=True).stdout.split()


def test_the_rest_stands_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "tideledger", tmp_path / "tideledger", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    total, dealt, closed = names(tmp_path)
    assert int(total) >= 139 and dealt == "0" and closed == "True"


def test_all_queries_are_registered():
    total, dealt, closed = names(ROOT)
    if (ROOT / "tideledger" / "llm").exists():
        assert dealt == "14" and int(total) >= 153
    assert closed == "True"
