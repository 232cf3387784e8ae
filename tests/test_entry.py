"""The entry points, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.abspath(__spark_entry__.__file__))


def test_entry(spark, sf):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "page_id", "n", "words", "first_pos", "last_pos"] and df.count() > 0


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_needs_the_subpackage(tmp_path):
    """In a copy without the subpackage and its tests, and with or without the pipeline, the rest imports and its tests pass."""
    drop = shutil.ignore_patterns("llm", "__pycache__", ".git", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=drop)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'words_inside_box' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = lambda *args: subprocess.run([sys.executable, *args], cwd=tmp_path / "copy", env=env, capture_output=True, text=True)
    for _ in range(2):
        got = run("-c", code)
        assert got.returncode == 0, got.stderr
        got = run("-m", "pytest", "-q", "-x", "tests", "--collect-only")
        assert got.returncode == 0, got.stdout
        got = run("-m", "pytest", "-q", "-x", "tests/test_entry.py", "-k", "sql_belongs")
        assert got.returncode == 0, got.stdout
        (tmp_path / "copy/corpus_pipeline.py").unlink(missing_ok=True)
