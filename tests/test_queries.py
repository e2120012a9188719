"""Every registered query against its SQL twin, on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as driver  # noqa: E402
import check  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not there")


@pytest.fixture(scope="module")
def database():
    return check.database(SF_DIR)


# these repeat the run behind run_results and run_index; tools/check.py covers them
REPEATED = {"run_report", "run_documents"}


@pytest.mark.parametrize("name", [name for name in driver.queries() if name not in REPEATED])
def test_query(spark, database, name):
    ok, text = check.compare(spark, database, SF_DIR, name)
    assert ok is not False, text


def test_every_twin_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    result = driver.entry(spark)
    assert result.columns == ["created", "updated", "skipped", "failed"] and result.count() == 1
