"""The driver's entry points."""

import subprocess
import sys
from pathlib import Path

import pytest

SMALL = "/root/testdata/sf0.001"


def test_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 50


def test_core_does_not_import_the_subpackage():
    code = "import sys; sys.modules['clausesearch.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(n.startswith('p1_') for n in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True).returncode == 0


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test data")
def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
