"""What the driver imports, whole and without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; print(len(e.queries()), *sorted(set(e.oracle_sql()) - set(e.queries())), *[n for n in e.queries() if n[:2] == 'op' or n == 'pipeline'])"


@pytest.mark.parametrize("gone", [["corpus_pipeline.py", "tidewater/llm", "tests/llm"], ["tidewater/llm", "tests/llm"], ["corpus_pipeline.py"]])
def test_the_rest_loads_without_the_corpus_operators(tmp_path, gone):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in gone and (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "tidewater", tmp_path / "tidewater", ignore=shutil.ignore_patterns("__pycache__", *(["llm"] if "tidewater/llm" in gone else [])))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", LIST], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) >= 39 and "pipeline" not in said
    assert len(said) == 1 if "tidewater/llm" in gone else True
