"""Without the optional folders the rest imports and has its queries."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_without_llm(tmp_path):
    for name in ("tessera", "__spark_entry__.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'file_scores' in n and not [k for k in n if k.startswith('op') or k == 'pipeline']; assert set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=120)


def test_nothing_imports_llm():
    for p in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in p.parts:
            assert "tessera.llm" not in p.read_text(), p
