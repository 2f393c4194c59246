import subprocess
import sys

import pytest

from gristmill.plans import catalog
from tests.compare import differences

SF_SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    assert differences(catalog.queries()[name](spark, SF_SMALL), catalog.oracle_sql()[name], SF_SMALL) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.queries()[name](spark, SF_SMALL).limit(1).count() == 1


def test_entry_imports_without_a_session():
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"], check=True, timeout=120)
