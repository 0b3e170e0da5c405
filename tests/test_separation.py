from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(x.startswith(('op', 'pipe')) for x in e.queries()))"


@pytest.mark.parametrize("gone", [("weft/llm", "tests/llm"), ("weft/llm", "tests/llm", "corpus_pipeline.py")])
def test_without_the_training_data_operators(tmp_path, gone):
    for name in ("weft", "tests", "__spark_entry__.py", "corpus_pipeline.py"):
        if (HERE / name).is_dir():
            shutil.copytree(HERE / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (HERE / name).exists():
            shutil.copy(HERE / name, tmp_path / name)
    for name in gone:
        path = tmp_path / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    out = subprocess.run([sys.executable, "-B", "-c", COUNT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    queries, oracles, left = map(int, out.stdout.split())
    assert queries == oracles > 40 and left == 0


def test_other_missing_modules_are_errors(tmp_path):
    for name in ("weft", "__spark_entry__.py"):
        (shutil.copytree if (HERE / name).is_dir() else shutil.copy)(HERE / name, tmp_path / name)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    out = subprocess.run([sys.executable, "-B", "-c", COUNT], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert out.returncode != 0 and "no_such_module" in out.stderr
