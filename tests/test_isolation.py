"""The repository without its corpus subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [["ledgerspark/llm", "tests/llm"], ["ledgerspark/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_corpus_operators(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *[x for g in gone for x in [Path(g).name] if x == "llm"], *[g for g in gone if g.endswith(".py")]))
    assert not any((copy / g).exists() for g in gone)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()), 'pipeline' in e.queries())"], cwd=copy, capture_output=True, text=True)
    n, sql, pipeline = said.stdout.split()[-3:]
    assert int(n) > 30 and (sql, pipeline) == ("True", "False")


def test_nothing_else_imports_the_corpus_operators():
    for path in (REPO / "ledgerspark").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "ledgerspark.llm" not in path.read_text(), path
