"""The driver's contract, with and without the subpackage for training data."""

import os
import shutil
import subprocess
import sys

import pytest

from tests.conftest import SF

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 50


def test_entry(spark):
    import __spark_entry__ as entry

    if not os.path.isdir(SF):
        pytest.skip("no tables")
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"source", "page_no", "para_no", "n_lines", "style"}


def test_rest_stands_alone(tmp_path):
    """Without folia/llm and the pipeline everything else imports."""
    shutil.copytree(os.path.join(ROOT, "folia"), tmp_path / "folia", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e, folia.plans.convert, folia.streaming, folia.sinks.pdf; q = e.queries(); assert q and not any(n.startswith('op1_') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
