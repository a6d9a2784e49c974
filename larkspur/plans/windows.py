"""Window functions, frames and percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators import udaf
from larkspur.operators import windows as W
from larkspur.plans import plan
from larkspur.sources.tables import Tables

_BY = "partition by o_custkey order by o_orderdate, o_orderkey"


def by_customer():
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


@plan("""select c_custkey, row_number() over w::int as rn, rank() over v::int as rk, dense_rank() over v::int as dr, round(percent_rank() over v, 6) as pr, round(cume_dist() over v, 6) as cd
from customer window w as (partition by c_mktsegment order by c_nationkey, c_custkey), v as (partition by c_mktsegment order by c_nationkey)""")
def window_ranking(t: Tables) -> DataFrame:
    v = Window.partitionBy("c_mktsegment").orderBy("c_nationkey")
    w = Window.partitionBy("c_mktsegment").orderBy("c_nationkey", "c_custkey")
    return t.customer.select("c_custkey", F.row_number().over(w).alias("rn"), F.rank().over(v).alias("rk"), F.dense_rank().over(v).alias("dr"), F.round(F.percent_rank().over(v), 6).alias("pr"), F.round(F.cume_dist().over(v), 6).alias("cd"))


@plan("select s_suppkey, ntile(7) over (order by s_acctbal, s_suppkey)::bigint as seven, ntile(4) over (partition by s_nationkey order by s_suppkey)::bigint as four from supplier")
def window_ntile(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", W.ntile(7, Window.orderBy("s_acctbal", "s_suppkey")).alias("seven"), W.ntile(4, Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("four"))


@plan("select n_nationkey, ntile(3) over (partition by n_regionkey order by n_nationkey)::bigint as b from nation")
def window_ntile_column(t: Tables) -> DataFrame:
    return t.nation.withColumn("k", F.lit(3)).select("n_nationkey", W.ntile(F.col("k"), Window.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("b"))


_V = "(values (1, 1, 10), (1, 2, null), (1, 3, 30), (1, 4, null), (1, 5, 50), (2, 1, null), (2, 2, 7)) v(g, i, x)"


def _v(t: Tables) -> DataFrame:
    return t.rows([(1, 1, 10), (1, 2, None), (1, 3, 30), (1, 4, None), (1, 5, 50), (2, 1, None), (2, 2, 7)], "g int, i int, x int")


@plan(f"""select g, i, lag(x) over w as l1, lead(x, 2, -1) over w as l2, lag(x, -1) over w as neg, lag(x ignore nulls) over w as li, lead(x, 2 ignore nulls) over w as le from {_V} window w as (partition by g order by i)""")
def window_lag_lead(t: Tables) -> DataFrame:
    w = Window.partitionBy("g").orderBy("i")
    return _v(t).select("g", "i", W.lag("x", w).alias("l1"), W.lead("x", w, 2, -1).alias("l2"), W.lag("x", w, -1).alias("neg"), W.lag("x", w, ignore_nulls=True).alias("li"), W.lead("x", w, 2, ignore_nulls=True).alias("le"))


@plan(f"""select g, i, first_value(x) over w as f, last_value(x) over a as l, nth_value(x, 3) over a as n3, first_value(x ignore nulls) over a as fi, last_value(x ignore nulls) over w as la, nth_value(x, 2 ignore nulls) over a as ni
from {_V} window w as (partition by g order by i), a as (partition by g order by i rows between unbounded preceding and unbounded following)""")
def window_values(t: Tables) -> DataFrame:
    w = Window.partitionBy("g").orderBy("i")
    a = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return _v(t).select("g", "i", F.first("x").over(w).alias("f"), F.last("x").over(a).alias("l"), W.nth_value("x", 3, a).alias("n3"), F.first("x", True).over(a).alias("fi"), F.last("x", True).over(w).alias("la"), W.nth_value("x", 2, a, ignore_nulls=True).alias("ni"))


@plan(f"select g, i, nth_value(x, 2) over (partition by g order by i desc rows between unbounded preceding and unbounded following) as second_last from {_V}")
def window_nth_from_last(t: Tables) -> DataFrame:
    a = Window.partitionBy("g").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return _v(t).select("g", "i", W.nth_value("x", 2, a, from_last=True).alias("second_last"))


@plan(f"select o_orderkey, count(*) over w as n, count(nullif(o_orderstatus, 'F')) over w as k, round(sum(o_totalprice) over w, 2) as s, round(avg(o_totalprice) over w, 6) as a, min(o_totalprice) over w as lo, max(o_orderpriority) over w as hi from orders window w as ({_BY})")
def window_running_aggregates(t: Tables) -> DataFrame:
    w = by_customer()
    return t.orders.select("o_orderkey", F.count(F.lit(1)).over(w).alias("n"), F.count(F.nullif("o_orderstatus", F.lit("F"))).over(w).alias("k"), F.round(F.sum("o_totalprice").over(w), 2).alias("s"), F.round(F.avg("o_totalprice").over(w), 6).alias("a"), F.min("o_totalprice").over(w).alias("lo"), F.max("o_orderpriority").over(w).alias("hi"))


@plan("select l_orderkey, l_linenumber, count(distinct l_suppkey) over w as n, sum(distinct l_quantity) over w as s, round(sum(distinct l_quantity) over w / count(distinct l_quantity) over w, 4) as a from lineitem window w as (partition by l_orderkey)")
def window_distinct(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", W.count_distinct("l_suppkey", w).alias("n"), W.sum_distinct("l_quantity", w).alias("s"), F.round(W.avg_distinct("l_quantity", w), 4).alias("a"))


@plan(f"select o_orderkey, round(sum(o_totalprice) over (w rows between 2 preceding and 1 following), 2) as a, count(*) over (w rows between current row and unbounded following) as b, max(o_totalprice) over (w rows between 3 preceding and 1 preceding) as c from orders window w as ({_BY})")
def window_frame_rows(t: Tables) -> DataFrame:
    w = by_customer()
    return t.orders.select("o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 1)), 2).alias("a"), F.count(F.lit(1)).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("b"), F.max("o_totalprice").over(w.rowsBetween(-3, -1)).alias("c"))


@plan("""select o_orderkey, count(*) over (partition by o_custkey order by o_orderdate range between interval 90 day preceding and current row) as near, round(sum(o_totalprice) over (partition by o_custkey order by o_totalprice range between 20000 preceding and 5000 following), 2) as close from orders""")
def window_frame_range(t: Tables) -> DataFrame:
    t.views("orders")
    return t.spark.sql("""select o_orderkey, count(*) over (partition by o_custkey order by o_orderdate range between interval '90' day preceding and current row) near,
        round(sum(o_totalprice) over (partition by o_custkey order by o_totalprice range between 20000.0d preceding and 5000.0d following), 2) close from orders""")


@plan("select l_orderkey, l_linenumber, sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey rows between l_linenumber % 3 preceding and l_linenumber % 2 following) as s from lineitem")
def window_frame_by_expression(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", W.rows_frame("sum", "l_quantity", F.col("l_linenumber") % 3, F.col("l_linenumber") % 2, w).alias("s"))


@plan("select s_suppkey, round(stddev_pop(s_acctbal) over w, 4) as sp, round(stddev_samp(s_acctbal) over w, 4) as ss, round(var_pop(s_acctbal) over w, 3) as vp, round(var_samp(s_acctbal) over w, 3) as vs from supplier window w as (partition by s_nationkey)")
def window_statistics(t: Tables) -> DataFrame:
    x = "s_acctbal"
    found = W.per_partition(t.supplier, ["s_nationkey"], sp=F.round(F.stddev_pop(x), 4), ss=F.round(F.stddev_samp(x), 4), vp=F.round(F.var_pop(x), 3), vs=F.round(F.var_samp(x), 3))
    return W.with_partition(t.supplier, ["s_nationkey"], found).select("s_suppkey", "sp", "ss", "vp", "vs")


@plan("select p_partkey, round(quantile_cont(p_retailprice, 0.3) over w, 4) as c, quantile_disc(p_retailprice, 0.3) over w as d, median(p_retailprice) over w as m from part window w as (partition by p_type)")
def window_percentiles(t: Tables) -> DataFrame:
    found = W.percentiles(t.part, ["p_type"], "p_retailprice", c=("cont", 0.3), d=("disc", 0.3), m=("cont", 0.5))
    return W.with_partition(t.part, ["p_type"], found).select("p_partkey", F.round("c", 4).alias("c"), "d", "m")


@plan("select o_orderkey, bit_and(o_orderkey) over w as a, bit_or(o_orderkey) over w as o, bit_xor(o_orderkey) over w as x from orders window w as (partition by o_custkey)")
def window_bits(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    return t.orders.select("o_orderkey", F.bit_and("o_orderkey").over(w).alias("a"), F.bit_or("o_orderkey").over(w).alias("o"), F.bit_xor("o_orderkey").over(w).alias("x"))


@plan("""select distinct l_returnflag, round(regr_slope(l_extendedprice, l_quantity) over w, 4) as sl, round(corr(l_extendedprice, l_quantity) over w, 6) as c, round(covar_pop(l_extendedprice, l_quantity) over w, 3) as cp, regr_count(l_extendedprice, l_quantity) over w::bigint as n
from lineitem window w as (partition by l_returnflag)""")
def window_regression(t: Tables) -> DataFrame:
    y, x = "l_extendedprice", "l_quantity"
    corr = F.try_divide(F.covar_pop(y, x), F.stddev_pop(y) * F.stddev_pop(x))
    return W.per_partition(t.lineitem, ["l_returnflag"], sl=F.round(F.regr_slope(y, x), 4), c=F.round(corr, 6), cp=F.round(F.covar_pop(y, x), 3), n=F.regr_count(y, x))


class SumOfSquares:
    """An analytic aggregate with ``drop``."""

    def reset(self):
        return 0.0

    def next(self, state, value):
        return state + (value or 0) ** 2

    def drop(self, state, value):
        return state - (value or 0) ** 2

    def evaluate(self, state):
        return state


@plan("""select c_custkey, sum(c_nationkey * c_nationkey) over (w rows between 3 preceding and current row)::double as last, sum(c_nationkey * c_nationkey) over (w rows between 2 preceding and 2 following)::double as around,
sum(c_nationkey * c_nationkey) over (w rows between unbounded preceding and current row)::double as upto from customer window w as (partition by c_mktsegment order by c_custkey)""")
def window_analytic_with_drop(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_mktsegment", "c_nationkey")
    for out, frame in (("last", {"preceding": 3}), ("around", {"preceding": 2, "following": 2}), ("upto", {})):
        rows = udaf.window_with(rows, ["c_mktsegment"], ["c_custkey"], "c_nationkey", SumOfSquares(), out, **frame)
    return rows.select("c_custkey", "last", "around", "upto")


@plan("select n_nationkey, string_agg(n_name, ',' order by n_nationkey) over (partition by n_regionkey order by n_nationkey rows between unbounded preceding and unbounded following) as all_names from nation")
def window_user_analytic(t: Tables) -> DataFrame:
    """A user aggregate over a window: any composition of built-in aggregates has the window's sliding evaluation."""
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t.nation.select("n_nationkey", F.array_join(F.collect_list("n_name").over(w), ",").alias("all_names"))


@plan("select c_custkey, round(c_acctbal - avg(c_acctbal) over (partition by c_nationkey), 4) as gap from customer qualify rank() over (partition by c_nationkey order by c_acctbal desc) <= 3")
def window_top_k_per_group(t: Tables) -> DataFrame:
    ranked = t.customer.select("c_custkey", "c_nationkey", "c_acctbal", F.rank().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"))).alias("r")).where("r <= 3")
    mean = W.per_partition(t.customer, ["c_nationkey"], mean=F.avg("c_acctbal"))
    return W.with_partition(ranked, ["c_nationkey"], mean).select("c_custkey", F.round(F.col("c_acctbal") - F.col("mean"), 4).alias("gap"))

