"""The entry without the optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_training_data_operators(tmp_path, pipeline):
    """The folders quarrystone/llm and tests/llm are gone, with corpus_pipeline.py there or not; an empty folder may be left."""
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and os.path.exists(f"{ROOT}/corpus_pipeline.py") else [])):
        shutil.copy(f"{ROOT}/{name}", tmp_path)
    shutil.copytree(f"{ROOT}/quarrystone", tmp_path / "quarrystone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    if not pipeline:
        (tmp_path / "quarrystone/llm/__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; from quarrystone.plans import queries as q; assert set(e.queries()) == set(q.QUERIES) and set(e.oracle_sql()) == set(q.ORACLES)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)


def test_entry_with_them():
    if not os.path.exists(f"{ROOT}/quarrystone/llm/__init__.py"):
        pytest.skip("the operators are not here")
    import __spark_entry__ as e

    assert any(name.startswith("op1_") for name in e.queries())
