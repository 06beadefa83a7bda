"""The entry point without the training-data subpackage, with and without the pipeline file."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

TOP = Path(__file__).resolve().parents[1]
CODE = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 80 and set(s) <= set(q); assert not [x for x in q if x.startswith('op') or x == 'pipeline']"


@pytest.mark.parametrize("pipeline", [True, False])
def test_imports_without_the_subpackage(tmp_path, pipeline):
    shutil.copytree(TOP / "evidence_lake", tmp_path / "evidence_lake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and (TOP / "corpus_pipeline.py").exists() else [])]:
        shutil.copy(TOP / name, tmp_path / name)
    got = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=120)
    assert got.returncode == 0, got.stderr[-800:]
