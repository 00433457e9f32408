"""The registry with and without the training-data subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(sorted(n for n in e.queries() if n.startswith('op') or n == 'pipeline'), len(e.queries()))"


@pytest.fixture
def copy(tmp_path):
    shutil.copytree(f"{ROOT}/changelore", tmp_path / "changelore", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    return tmp_path


def shown(folder) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, timeout=120, check=False)


def test_without_the_subpackage_the_other_queries_stay(copy):
    got = shown(copy)
    assert got.returncode == 0, got.stderr
    assert got.stdout.startswith("[] ") and int(got.stdout.split()[1]) > 100


def test_an_empty_folder_of_the_subpackage_is_no_subpackage(copy):
    (copy / "changelore" / "llm").mkdir()
    (copy / "corpus_pipeline.py").write_text("from changelore.llm import bpe\n")
    assert shown(copy).stdout.startswith("[] ")


@pytest.mark.parametrize("fault", ["import no_such_module", "from changelore.llm import no_such_name", "1 / 0"])
def test_a_fault_inside_the_subpackage_is_an_error(copy, fault):
    (copy / "changelore" / "llm").mkdir()
    (copy / "changelore" / "llm" / "__init__.py").write_text("")
    (copy / "changelore" / "llm" / "queries.py").write_text("QUERIES = {}\nORACLES = {}\n")
    (copy / "corpus_pipeline.py").write_text(f"{fault}\n")
    assert shown(copy).returncode != 0
