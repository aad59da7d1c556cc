"""The contract without the optional subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_the_corpus_operators(tmp_path):
    """With the subpackage gone, all other queries are still there and only they."""
    shutil.copytree(ROOT / "labelloom", tmp_path / "labelloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    code = ("import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and set(e.oracle_sql()) <= set(q); "
            "assert not any(n == 'pipeline' or n.startswith('op') and n[2].isdigit() for n in q)")
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
