"""The entry with and without the operators for training data."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
ASK = "import __spark_entry__ as e; print(' '.join(sorted(e.queries()))); print(' '.join(sorted(e.oracle_sql())))"


def asked(root):
    out = subprocess.run([sys.executable, "-c", ASK], cwd=root, capture_output=True, text=True, check=True).stdout.split("\n")
    return set(out[0].split()), set(out[1].split())


def test_sql_belongs_to_queries():
    names, sql = asked(ROOT)
    assert sql <= names and len(names) > 80


@pytest.mark.parametrize("also", [True, False])
def test_without_training_data(tmp_path, also):
    """With both folders gone, with or without the pipeline's module, the rest imports and keeps its queries."""
    root = tmp_path / "copy"
    shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json", "spark-warehouse"))
    if also:
        (root / "corpus_pipeline.py").unlink(missing_ok=True)
    names, sql = asked(root)
    everything, _ = asked(ROOT)
    assert names == {n for n in everything if n != "pipeline" and not (n.startswith("op") and "_" in n and n[2].isdigit())} and sql <= names
