import pytest

import __spark_entry__ as entry
from silkweb.plans import queries as web
from tests.same import same


@pytest.mark.parametrize("name", sorted(web.queries()))
def test_query_gives_its_sql(name, spark):
    same(web.queries()[name], web.oracle_sql()[name], spark)


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.count() > 0 and set(frame.columns) == {"page_id", "url", "file", "hash", "chars"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
