"""The library without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def registered(folder):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    run = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120,
                         env={**os.environ, "PYTHONPATH": ""})
    assert run.returncode == 0, run.stderr
    names, sql = run.stdout.splitlines()[-2:]
    return set(names.split()), set(sql.split())


def test_queries_without_the_subpackage_and_the_pipeline(tmp_path):
    from offerlens.oracle import ORACLE
    from offerlens.plans.catalog import QUERIES
    for name, left_out in (("folders", ("llm",)), ("both", ("llm", "corpus_pipeline.py"))):
        copy = tmp_path / name
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests", *left_out))
        assert registered(copy) == (set(QUERIES), set(ORACLE))
