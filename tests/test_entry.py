"""The driver's contract, with and without the corpus operators."""

import importlib
import importlib.util
import subprocess
import sys

from places import ROOT


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_corpus_operators(tmp_path):
    import shutil

    keep = lambda folder, names: [n for n in names if n in ("llm", ".git", "corpus_pipeline.py", "__pycache__")]
    shutil.copytree(ROOT, tmp_path / "repo", ignore=keep)
    code = "import __spark_entry__ as e; assert not [n for n in e.queries() if n.startswith('op') or n == 'pipeline'], 1; assert len(e.queries()) > 90"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})


def test_nothing_outside_imports_the_corpus_operators():
    import pathlib

    for p in pathlib.Path(ROOT, "rankloom").rglob("*.py"):
        assert "llm" in p.parts or "rankloom.llm" not in p.read_text(), p
