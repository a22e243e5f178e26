"""The entry module with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(n for n in e.queries() if n[:2] == 'op' or n == 'pipeline'))"


@pytest.mark.parametrize("gone", [["lodestream/llm", "tests/llm"], ["lodestream/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_the_corpus_operators(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        target = copy / name
        if target.is_dir():
            shutil.rmtree(target)
        elif target.exists():
            target.unlink()
    said = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=copy, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    n, sql, corpus = said.stdout.split(maxsplit=2)
    assert int(n) >= 234 and int(sql) >= 200 and corpus.strip() == "[]"
