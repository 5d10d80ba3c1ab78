"""The library without its training-data subpackage: entry points still import and run."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("gone", [("pairmill/llm", "tests/llm"), ("pairmill/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_without_training_data_operators(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        shutil.rmtree(copy / name) if (copy / name).is_dir() else (copy / name).unlink()
    said = "import __spark_entry__ as e; names = set(e.queries()); assert 's01_column_scan' in names and set(e.oracle_sql()) <= names; print(any(n.startswith('op') for n in names))"
    env = os.environ | {"PYTHONPATH": os.pathsep.join(x for x in os.environ.get("PYTHONPATH", "").split(os.pathsep) if x and Path(x) != ROOT)}
    done = subprocess.run([sys.executable, "-c", said], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and done.stdout.strip().endswith("False"), done.stderr
