from __future__ import annotations

import subprocess
import sys
import tempfile
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_corpus_package():
    with tempfile.TemporaryDirectory() as folder:
        code = (
            "import shutil, sys; shutil.copytree(sys.argv[1] + '/provenlace', sys.argv[2] + '/provenlace', ignore=shutil.ignore_patterns('llm', '__pycache__'));"
            "shutil.copy(sys.argv[1] + '/__spark_entry__.py', sys.argv[2]); sys.path.insert(0, sys.argv[2]);"
            "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'bm25_topk' in q"
        )
        subprocess.run([sys.executable, "-c", code, str(ROOT), folder], check=True, cwd=folder, env={"PATH": "/usr/bin:/bin", "HOME": folder})
