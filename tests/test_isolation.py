"""The rest of the library works without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_imports_without_the_llm_folders(tmp_path, pipeline):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    if not pipeline:
        (tmp_path / "copy" / "corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(sum(k.startswith('op') or k == 'pipeline' for k in q), len(q))"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert got.returncode == 0, got.stderr
    training, all_ = map(int, got.stdout.split())
    assert training == 0 and all_ > 100
