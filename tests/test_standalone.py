"""The entry module without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from scorelens.plans import catalog

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_without_the_training_data_operators(tmp_path, with_pipeline):
    shutil.copytree(ROOT / "scorelens", tmp_path / "scorelens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * (with_pipeline and (ROOT / "corpus_pipeline.py").exists()):
        shutil.copy(ROOT / name, tmp_path / name)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.QUERIES), *sorted(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == ["True", *sorted(catalog.QUERIES)]
