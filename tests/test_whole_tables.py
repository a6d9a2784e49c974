"""Queries whose results show that every row of their tables was read."""

from larkspur import plans
from tests.compare import same

plans.load()
SF = "/root/testdata/sf0.001"


def whole(spark, duck, name, n):
    df = plans.runnable(plans.PLANS[name])(spark, SF)
    same(df, duck, plans.SQL[name])
    assert df.count() == duck.execute(n).fetchone()[0]


def test_union_promotes_numbers_over_whole_tables(spark, duck):
    whole(spark, duck, "union_promotes_numbers", "select (select count(*) from customer) + (select count(*) from supplier)")


def test_every_order_and_every_nation_is_inserted(spark, duck):
    whole(spark, duck, "insert_from_select", "select count(distinct o_orderstatus) from orders")
    whole(spark, duck, "stream_insert", "select count(*) from nation")


def test_time_of_day_of_every_event(spark, duck):
    whole(spark, duck, "date_time_of_day", "select count(*) from events")
