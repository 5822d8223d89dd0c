"""Every query with SQL gives the rows of its SQL on the smallest tables; the package stands without its subpackage."""

import importlib
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.compare import compare

ROOT = Path(entry.__file__).resolve().parent


def core() -> list[str]:
    names: list[str] = []
    for m in ("profilespark.plans.records", "profilespark.plans.matrix", "profilespark.plans.frames"):
        names += sorted(set(importlib.import_module(m).ORACLE))
    return names


@pytest.mark.parametrize("name", core())
def test_against_sql(spark, sf_dir, name):
    assert compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], sf_dir) == ""


def test_entry(spark, sf_dir):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_imports_without_subpackage():
    code = "import sys; sys.modules['profilespark.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p3_found' in q and 'p8_found' not in q"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, timeout=120).returncode == 0
