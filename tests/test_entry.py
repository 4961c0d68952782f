"""The driver contract holds with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n.startswith(('op', 'pipeline')) for n in q))"


def ask(folder, *options):
    got = subprocess.run([sys.executable, *options, "-c", ASK], cwd=folder, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
    return tuple(map(int, got.stdout.split()))


@pytest.fixture()
def copy(tmp_path):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", ".pytest_cache"))
    return tmp_path / "repo"


@pytest.mark.parametrize("gone", [["geoloom/llm"], ["corpus_pipeline.py"], ["geoloom/llm", "corpus_pipeline.py", "tests/llm"]])
def test_entry_survives_deletions(copy, gone):
    for name in gone:
        path = copy / name
        if path.exists():
            shutil.rmtree(path) if path.is_dir() else path.unlink()
    n, llm = ask(copy)
    assert n - llm >= 40
    if "geoloom/llm" in gone:
        assert llm == 0


def test_a_missing_library_takes_only_its_own_queries(copy):
    if not (copy / "geoloom/llm").exists():
        pytest.skip("nothing to leave out")
    (copy / "xxhash.py").write_text("raise ImportError('not here')\n")
    n, llm = ask(copy)
    assert n >= 40 and llm == 0


def test_nothing_else_imports_the_subpackage():
    for path in (REPO / "geoloom").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "geoloom.llm" not in path.read_text(), path
