import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry_module

ROOT = Path(__file__).resolve().parent.parent


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    for name in ("__spark_entry__.py", "tessera"):
        src = ROOT / name
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "tessera" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tpch_q1' in q and not any(k.startswith('op') and k[2].isdigit() for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin"}, check=True)


def test_nothing_else_imports_the_corpus_operators():
    for p in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "tessera.llm" not in p.read_text() and "from .llm" not in p.read_text(), p
