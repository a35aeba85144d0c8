"""The rest of the library without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

HOME = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_corpus_operators(tmp_path, pipeline):
    """The catalogue imports and lists its own queries when the optional folders, and the pipeline beside them, are gone."""
    shutil.copytree(HOME / "sievework", tmp_path / "sievework", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *["corpus_pipeline.py"] * pipeline]:
        if (HOME / name).exists():
            shutil.copy(HOME / name, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'score_results' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
