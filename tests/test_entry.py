"""The entry points with and without the operators for training text."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from checks.queries import registered

REPO = Path(__file__).resolve().parents[1]
NAMES = "import __spark_entry__ as e; print(sorted(e.queries()) == {want}, sorted(e.oracle_sql()) == {want})"


def test_every_query_of_the_advisor_is_registered():
    assert set(registered()) <= set(__spark_entry__.queries())
    assert set(registered()) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_the_rest_works_without_the_text_operators(tmp_path, left):
    """A copy without the subpackage, with and without the pipeline's file."""
    for name in ("tellwise", "checks", "__spark_entry__.py", *left):
        source = REPO / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    code = NAMES.format(want=repr(sorted(registered())))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.stdout.split()[-2:] == ["True", "True"], done.stderr
