"""The driver's entry without the corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [["worksight/llm", "tests/llm", "corpus_pipeline.py"], ["worksight/llm", "tests/llm"]])
def test_queries_without_corpus_operators(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        at = copy / name
        if at.is_dir():
            shutil.rmtree(at)
        elif at.exists():
            at.unlink()
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 60 and set(s) <= set(q) and not any(k.startswith('op') or k == 'pipeline' for k in q); import bench"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=env, timeout=120)
