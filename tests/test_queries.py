"""Every query of the engine against its SQL at the smallest scale."""

import pytest

from larkspur import plans
from tests.compare import same

plans.load()
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.PLANS))
def test_query_against_sql(spark, duck, name):
    df = plans.runnable(plans.PLANS[name])(spark, SF)
    assert name in plans.SQL, "every relational query has its SQL"
    same(df, duck, plans.SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
