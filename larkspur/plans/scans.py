"""Scans, projections, filters, ordering and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import logic, numbers
from larkspur.operators.relational import top
from larkspur.plans import plan
from larkspur.plans.benchmark import ts
from larkspur.sources.tables import Tables, with_pseudo_columns


@plan("select c_custkey, c_name from customer where c_acctbal > 5000")
def scan_pushed_filter(t: Tables) -> DataFrame:
    return t.customer.where("c_acctbal > 5000").select("c_custkey", "c_name")


@plan("select p_partkey from part where p_name = 'red widget' or p_name like 'blue%'")
def scan_string_filter(t: Tables) -> DataFrame:
    return t.part.where((F.col("p_name") == "red widget") | F.col("p_name").startswith("blue")).select("p_partkey")


@plan("select l_orderkey, l_linenumber from lineitem where l_quantity > l_extendedprice / 1000 and l_linenumber < 3")
def scan_column_against_column(t: Tables) -> DataFrame:
    return t.lineitem.where((F.col("l_quantity") > F.col("l_extendedprice") / 1000) & (F.col("l_linenumber") < 3)).select("l_orderkey", "l_linenumber")


@plan("select count(*) as n, count(distinct o_orderkey) as n_rids, 1::bigint as n_files from orders")
def scan_pseudo_columns(t: Tables) -> DataFrame:
    rows = with_pseudo_columns(t.orders)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("extent_rid", "file_path").alias("n_rids"), F.count_distinct("file_path").alias("n_files"))


@plan("select 1::int as one, 'x' as text, null::int as nothing")
def constant_source(t: Tables) -> DataFrame:
    return t.constant(one=1, text="x", nothing=F.lit(None).cast("int"))


@plan("select r_regionkey, r_name from region where 1 = 0")
def constant_false(t: Tables) -> DataFrame:
    return t.region.where(F.lit(1) == 0)


@plan("select s_suppkey, round(s_acctbal * 2 - s_suppkey / 3.0 + 7, 4) as e, case when s_suppkey % 10 <> 0 then round(s_acctbal / (s_suppkey % 10), 4) end as q, (-s_suppkey) % 7 as m from supplier")
def arithmetic(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select("s_suppkey", F.round(F.col("s_acctbal") * 2 - k / 3.0 + 7, 4).alias("e"), F.round(numbers.divide("s_acctbal", k % 10), 4).alias("q"), numbers.mod(-k, F.lit(7)).alias("m"))


@plan("""select o_orderkey from orders where (o_totalprice between 100000 and 150000 or o_orderpriority in ('1-URGENT', '5-LOW')) and o_orderstatus not in ('F') and not (o_custkey between 10 and 500)""")
def filter_between_in(t: Tables) -> DataFrame:
    test = (logic.between("o_totalprice", F.lit(100000), F.lit(150000)) | logic.in_list("o_orderpriority", "1-URGENT", "5-LOW")) & ~logic.in_list("o_orderstatus", "F")
    return t.orders.where(test & logic.not_between("o_custkey", F.lit(10), F.lit(500))).select("o_orderkey")


@plan("select p_partkey from part where (p_size > 25) <> (p_type = 'PROMO')")
def filter_xor(t: Tables) -> DataFrame:
    return t.part.where(logic.xor(F.col("p_size") > 25, F.col("p_type") == "PROMO")).select("p_partkey")


@plan("select p_partkey, regexp_matches(p_name, '^(red|blue) .*t$') as hit, p_name like '%g_t' as likes, p_name not like 'r%' as unlike from part")
def filter_regexp_like(t: Tables) -> DataFrame:
    from larkspur.functions import text

    return t.part.select("p_partkey", text.regexp_like("p_name", "^(red|blue) .*t$").alias("hit"), text.like("p_name", "%g_t").alias("likes"), (~text.like("p_name", "r%")).alias("unlike"))


_BOOLS = "(values (1, true), (2, false), (3, null::boolean)) v(id, b)"


@plan(f"select id, b is true as a, b is false as c, b is not true as d, b is not false as e, b is null as f, b is not null as g from {_BOOLS}")
def filter_is_true_false(t: Tables) -> DataFrame:
    b = F.col("b")
    rows = t.rows([(1, True), (2, False), (3, None)], "id int, b boolean")
    return rows.select("id", logic.is_true(b).alias("a"), logic.is_false(b).alias("c"), logic.is_not_true(b).alias("d"), logic.is_not_false(b).alias("e"), b.isNull().alias("f"), b.isNotNull().alias("g"))


@plan("select * from (values (1, '', false, true), (2, null, true, null::boolean)) v(id, s, s_null, s_empty)")
def empty_is_not_null(t: Tables) -> DataFrame:
    return t.rows([(1, ""), (2, None)], "id int, s string").select("id", "s", F.col("s").isNull().alias("s_null"), (F.col("s") == "").alias("s_empty"))


@plan("select o_custkey, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1 having count(*) > 12 and sum(o_totalprice) > 100000")
def filter_having(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")).where("n > 12 and total > 100000").select("o_custkey", "n", F.round("total", 2).alias("total"))


@plan("select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 200000 where c_nationkey = 4")
def outer_join_on_filter(t: Tables) -> DataFrame:
    big = t.orders.where("o_totalprice > 200000")
    return t.customer.where("c_nationkey = 4").join(big, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@plan("select distinct o_orderstatus, o_orderpriority from orders")
def distinct_rows(t: Tables) -> DataFrame:
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@plan("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def order_limit_top_k(t: Tables) -> DataFrame:
    return top(t.orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], 25).select("o_orderkey", "o_totalprice")


@plan("select o_orderkey from orders order by o_orderkey limit 7 offset 40")
def limit_offset(t: Tables) -> DataFrame:
    return top(t.orders, [F.asc("o_orderkey")], 7, 40).select("o_orderkey")


@plan("select o_orderkey from orders limit 0")
def limit_zero(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey").limit(0)


@plan("select count(*) as n from (select 1 from lineitem limit 100)")
def limit_without_order(t: Tables) -> DataFrame:
    return t.lineitem.limit(100).agg(F.count(F.lit(1)).alias("n"))


@plan("select distinct o_custkey from orders order by o_custkey desc limit 15")
def distinct_order_limit(t: Tables) -> DataFrame:
    return top(t.orders.select("o_custkey").distinct(), [F.desc("o_custkey")], 15)


@plan("select c_name from customer order by c_acctbal, c_custkey limit 10")
def order_by_hidden_column(t: Tables) -> DataFrame:
    return top(t.customer.select("c_name", "c_acctbal", "c_custkey"), [F.asc("c_acctbal"), F.asc("c_custkey")], 10, hidden=["c_acctbal", "c_custkey"])


@plan("select round(avg(v), 4) as mean from (select o_totalprice as v from orders order by o_totalprice desc, o_orderkey limit 50)")
def order_limit_in_subquery(t: Tables) -> DataFrame:
    return top(t.orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], 50).agg(F.round(F.avg("o_totalprice"), 4).alias("mean"))


@plan("select id, s, row_number() over (order by s nulls first, id)::int as asc_place, row_number() over (order by s desc nulls last, id)::int as desc_place from (values (1, 'b'), (2, null), (3, 'a'), (4, 'b')) v(id, s)")
def null_ordering(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    rows = t.rows([(1, "b"), (2, None), (3, "a"), (4, "b")], "id int, s string")
    return rows.select("id", "s", F.row_number().over(Window.orderBy(F.asc("s"), "id")).alias("asc_place"), F.row_number().over(Window.orderBy(F.desc("s"), "id")).alias("desc_place"))


@plan("select event_type, count(*) as n from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-12' group by 1")
def scan_time_range(t: Tables) -> DataFrame:
    return t.events.where((F.col("ts") >= ts("2024-01-10")) & (F.col("ts") < ts("2024-01-12"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@plan("select s_suppkey, 'fixed' as label, null::bigint as gap, s_suppkey + 1 as next_key from supplier")
def constants_after_scan(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", F.lit("fixed").alias("label"), F.lit(None).cast("bigint").alias("gap"), (F.col("s_suppkey") + 1).alias("next_key"))
