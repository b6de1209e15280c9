"""The library, its queries and its SQL stand without the llm folders and the pipeline module."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_queries_without_the_llm_folders(tmp_path, with_pipeline):
    shutil.copytree(ROOT / "evigraph", tmp_path / "evigraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if with_pipeline and (ROOT / "corpus_pipeline.py").exists() else [])]:
        shutil.copy(ROOT / name, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k.startswith('op') and k[2:3].isdigit() or k == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=False)
    assert ran.returncode == 0, ran.stderr


def test_every_sql_has_its_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
