"""Joins, set operations, subqueries and common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import relational as R
from larkspur.plans import plan
from larkspur.sources.files import DERBY, cross_engine, derby_archive
from larkspur.sources.tables import Tables

_A = "(values (1), (2), (null), (4), (4)) a(x)"
_B = "(values (2), (4), (5), (null)) b(y)"


def _ab(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.rows([(1,), (2,), (None,), (4,), (4,)], "x int"), t.rows([(2,), (4,), (5,), (None,)], "y int")


for _how, _word in (("inner", "join"), ("left", "left join"), ("right", "right join"), ("full", "full join")):

    @plan(f"select x, y from {_A} {_word} {_B} on x = y", name=f"join_{_how}_with_nulls")
    def _join(t: Tables, how: str = _how) -> DataFrame:
        a, b = _ab(t)
        return R.equi_join(a, b, F.col("x") == F.col("y"), how)


@plan("select c_custkey, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def join_broadcast_chain(t: Tables) -> DataFrame:
    named = R.equi_join(t.nation, t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return R.equi_join(t.customer, named, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@plan("select o_orderpriority, count(*) as n from orders join lineitem on o_orderkey = l_orderkey group by 1")
def join_partitioned(t: Tables) -> DataFrame:
    """Both sides too large to broadcast: shuffled on the key, skewed partitions split."""
    return R.equi_join(t.lineitem, t.orders, F.col("l_orderkey") == F.col("o_orderkey"), limit=0).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@plan("select c_custkey from customer where exists (from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def join_semi_exists(t: Tables) -> DataFrame:
    return R.semi(t.customer, t.orders.where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey")


@plan("select c_custkey from customer where not exists (from orders where o_custkey = c_custkey)")
def join_anti_not_exists(t: Tables) -> DataFrame:
    return R.anti(t.customer, t.orders, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey")


@plan(f"select x from {_A} where x not in (select y from {_B} where y > 2)")
def join_not_in(t: Tables) -> DataFrame:
    a, b = _ab(t)
    return R.not_in(a, "x", b.where("y > 2"))


@plan(f"select x from {_A} where x not in (select y from {_B})")
def join_not_in_with_null(t: Tables) -> DataFrame:
    a, b = _ab(t)
    return R.not_in(a, "x", b)


@plan(f"select x from {_A} where x not in (select y from {_B} where y > 9)")
def join_not_in_empty(t: Tables) -> DataFrame:
    a, b = _ab(t)
    return R.not_in(a, "x", b.where("y > 9"))


@plan("select l_orderkey, l_linenumber from lineitem where l_quantity > (select 1.5 * avg(o.l_quantity) from lineitem o where o.l_partkey = lineitem.l_partkey)")
def join_correlated_scalar(t: Tables) -> DataFrame:
    mean = t.lineitem.groupBy(F.col("l_partkey").alias("k")).agg((F.avg("l_quantity") * 1.5).alias("least"))
    return t.lineitem.join(mean, (F.col("l_partkey") == F.col("k")) & (F.col("l_quantity") > F.col("least"))).select("l_orderkey", "l_linenumber")


@plan("select p_partkey, s_suppkey from part join supplier on p_partkey % 50 = s_suppkey + 1 and p_size > 20")
def join_on_function(t: Tables) -> DataFrame:
    return R.equi_join(t.part.where("p_size > 20"), t.supplier, F.col("p_partkey") % 50 == F.col("s_suppkey") + 1).select("p_partkey", "s_suppkey")


@plan("select a.l_orderkey, count(*) as n from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_suppkey = b.l_suppkey and a.l_linenumber < b.l_linenumber group by 1")
def join_compound_self_theta(t: Tables) -> DataFrame:
    a, b = t.lineitem.alias("a"), t.lineitem.alias("b")
    on = (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_suppkey") == F.col("b.l_suppkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber"))
    return a.join(b, on).groupBy("a.l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@plan("select c.c_custkey, s.s_suppkey from customer c join supplier s on c.c_nationkey = s.s_nationkey and c.c_acctbal < s.s_acctbal - 5000")
def join_circular_residual(t: Tables) -> DataFrame:
    customers, suppliers = t.customer.select("c_custkey", "c_nationkey", "c_acctbal"), t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal")
    return R.less_join(customers, suppliers, ("c_nationkey", "s_nationkey"), (F.col("c_acctbal"), F.col("s_acctbal") - 5000)).select("c_custkey", "s_suppkey")


@plan("select r_name, p_type from region, (select distinct p_type from part)")
def join_cartesian_small(t: Tables) -> DataFrame:
    """A product of two tables of a few rows each, as the query asks for it."""
    return t.region.select("r_name").crossJoin(F.broadcast(t.part.select("p_type").distinct()))


@plan("select a.n_name as a, b.n_name as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def join_self(t: Tables) -> DataFrame:
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@plan("select o_orderkey, d from orders join (values (0::decimal(38,0), 'zero'), (7::decimal(38,0), 'seven')) v(k, d) on o_custkey = k")
def join_wide_decimal_key(t: Tables) -> DataFrame:
    from decimal import Decimal

    keys = t.rows([(Decimal(0), "zero"), (Decimal(7), "seven")], "k decimal(38,0), d string")
    return R.equi_join(t.orders, keys, F.col("o_custkey").cast("decimal(38,0)") == F.col("k")).select("o_orderkey", "d")


@plan("select n_name, k from nation join (select s_nationkey, count(*) as k from supplier group by 1) on n_nationkey = s_nationkey")
def join_cross_engine(t: Tables) -> DataFrame:
    """Another engine (here Spark's embedded Derby) holds the suppliers and aggregates them; its rows come over JDBC."""
    url = derby_archive(t.supplier.select("s_suppkey", "s_nationkey"), "suppliers")
    other = cross_engine(t.spark, url, 'select "s_nationkey" as s_nationkey, count(*) as k from suppliers group by "s_nationkey"', driver=DERBY)
    return R.equi_join(t.nation, other, F.col("n_nationkey") == F.col("S_NATIONKEY")).select("n_name", F.col("K").cast("bigint").alias("k"))


@plan("""select o_custkey, round(sum(o_totalprice), 2) as total from orders group by 1
having sum(o_totalprice) > (select 20 * max(abs(c_acctbal)) from customer where c_custkey = o_custkey)""")
def having_correlated_subquery(t: Tables) -> DataFrame:
    return t.spark.sql("""select o_custkey, round(sum(o_totalprice), 2) as total from {orders} group by o_custkey
having sum(o_totalprice) > (select 20 * max(abs(c_acctbal)) from {customer} where c_custkey = o_custkey)""", orders=t.orders, customer=t.customer)  # fmt: skip


_U = "(values (1, 'a'), (2, 'b'), (2, 'b'), (null, 'c')) u(i, c)"
_V = "(values (2, 'b'), (3, 'd'), (null, 'c')) v(i, c)"


def _uv(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.rows([(1, "a"), (2, "b"), (2, "b"), (None, "c")], "i int, c string"), t.rows([(2, "b"), (3, "d"), (None, "c")], "i int, c string")


@plan(f"select * from {_U} union all select * from {_V}")
def union_all(t: Tables) -> DataFrame:
    return R.union(*_uv(t))


@plan(f"select * from {_U} union select * from {_V}")
def union_distinct(t: Tables) -> DataFrame:
    return R.union(*_uv(t), distinct=True)


@plan(f"select i::varchar as i from {_U} union all select c from {_V}")
def union_promotes_to_text(t: Tables) -> DataFrame:
    a, b = _uv(t)
    return R.union(a.select("i"), b.select("c"))


@plan("select c_acctbal as v from customer union all select s_suppkey::double from supplier")
def union_promotes_numbers(t: Tables) -> DataFrame:
    return R.union(t.customer.select(F.col("c_acctbal").alias("v")), t.supplier.select("s_suppkey"))


@plan(f"select * from {_U} intersect select * from {_V}")
def intersect_distinct(t: Tables) -> DataFrame:
    return R.intersect(*_uv(t))


@plan(f"select * from {_U} except select * from {_V}")
def except_distinct(t: Tables) -> DataFrame:
    return R.except_(*_uv(t))


@plan("select y, max(n) as most from (select o_custkey, year(o_orderdate)::int as y, count(*) as n from orders group by all) group by y")
def derived_table(t: Tables) -> DataFrame:
    per = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("y").agg(F.max("n").alias("most"))


@plan("select s_suppkey, (select max(o_totalprice) from orders) as top from supplier")
def scalar_subquery_in_select(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey").join(F.broadcast(R.scalar(t.orders.agg(F.max("o_totalprice").alias("top")))))


@plan("select o_orderkey from orders where o_totalprice between (select 2 * avg(o_totalprice) from orders) and (select max(o_totalprice) from orders)")
def scalar_subquery_between(t: Tables) -> DataFrame:
    bounds = t.orders.agg((F.avg("o_totalprice") * 2).alias("low"), F.max("o_totalprice").alias("high"))
    return t.orders.join(F.broadcast(bounds), F.col("o_totalprice").between(F.col("low"), F.col("high"))).select("o_orderkey")


@plan("select o_orderkey, o_custkey from orders where (o_custkey, o_orderdate) in (select o_custkey, max(o_orderdate) from orders group by 1)")
def row_value_in_subquery(t: Tables) -> DataFrame:
    last = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderdate").alias("d"))
    return R.semi(t.orders, last, (F.col("o_custkey") == F.col("k")) & (F.col("o_orderdate") == F.col("d"))).select("o_orderkey", "o_custkey")


@plan("with big as (select * from orders where o_totalprice > 250000), per as (select o_custkey, count(*) as n from big group by 1) select n, count(*) as customers from per group by n")
def common_table_expression(t: Tables) -> DataFrame:
    t.views("orders")
    return t.spark.sql("with large as (select o_custkey from orders where o_totalprice > 250000), counted as (select o_custkey, count(*) n from large group by all) select n, count(*) customers from counted group by all")


@plan("with recursive f(n, v) as (select 1, 1::bigint union all select n + 1, v * (n + 1) from f where n < 12) select n, v from f")
def recursive_cte(t: Tables) -> DataFrame:
    return t.spark.sql("with recursive fact(n, v) as (select 1, cast(1 as bigint) union all select n + 1, v * (n + 1) from fact where n < 12) select n, v from fact")


@plan("select c_mktsegment, count(*) as n from customer where c_acctbal > 0 group by 1")
def view_expansion(t: Tables) -> DataFrame:
    t.customer.where("c_acctbal > 0").createOrReplaceTempView("solvent")
    return t.spark.table("solvent").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
