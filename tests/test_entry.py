"""The registry works with the corpus operators and without them."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
ASK = "import re, __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(bool(re.match(r'op\\d|pipeline', k)) for k in q))"


def ask(folder):
    got = subprocess.run([sys.executable, "-c", ASK], cwd=folder, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)})
    assert got.returncode == 0, got.stderr
    return [int(x) for x in got.stdout.split()]


def test_registry_without_corpus_operators(tmp_path):
    there = (REPO / "annolith" / "llm").exists()
    total, corpus = ask(REPO) if there else (0, 0)
    skip = shutil.ignore_patterns("llm", "__pycache__", ".git", "tests")
    for with_pipeline in (True, False):
        at = tmp_path / str(with_pipeline)
        shutil.copytree(REPO, at, ignore=skip)
        if not with_pipeline:
            (at / "corpus_pipeline.py").unlink(missing_ok=True)
        left, none = ask(at)
        assert left and none == 0 and (not there or (left == total - corpus and corpus == 14))
