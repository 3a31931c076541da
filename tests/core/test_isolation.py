"""The library without the training-data subpackage: the entry module and all other queries stay."""

import os
import re
import shutil
import subprocess
import sys

import pytest

import __spark_entry__

ROOT = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), e.llm, e.corpus_pipeline)"


@pytest.mark.parametrize("pipeline_too", [False, True])
def test_entry_without_the_subpackage(tmp_path, pipeline_too):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for folder in ("vintage/llm", "tests/llm"):
        shutil.rmtree(copy / folder, ignore_errors=True)
    if pipeline_too:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    own = [n for n in __spark_entry__.queries() if not re.match(r"op\d|pipeline$", n)]
    assert out.stdout.split() == [str(len(own)), str(len(own)), "None", "None"] and len(own) >= 108


def test_other_missing_modules_are_errors(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    package = copy / "vintage" / "llm"
    package.mkdir(exist_ok=True)
    (package / "__init__.py").write_text("")
    (package / "queries.py").write_text("import a_module_that_is_nowhere\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode and "a_module_that_is_nowhere" in out.stderr
