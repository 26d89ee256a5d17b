"""The entry module with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from pagequarry.plans import all_queries

ROOT = Path(entry.__file__).parent
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_corpus_operators(tmp_path):
    """With the corpus folders and the pipeline deleted, or the folders alone, the other queries are all there."""
    shutil.copytree(ROOT, tmp_path / "all", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    for name in ("all", "none"):
        if name == "none":
            shutil.copytree(tmp_path / "all", tmp_path / name, ignore=shutil.ignore_patterns("corpus_pipeline.py"))
            (tmp_path / name / "pagequarry" / "llm" / "__pycache__").mkdir(parents=True)
        said = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=tmp_path / name, capture_output=True, text=True, check=True)
        assert said.stdout.split() == [str(len(all_queries()[k])) for k in (0, 1)]
