"""The 22 decision-support queries, adapted to the tables at hand.

There is no part-supplier table, so supply offers are the (part, supplier) pairs of ``lineitem`` with
their smallest unit price; ship dates stand in for commit and receipt dates; countries for phone codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.relational import anti, equi_join, not_in, semi
from larkspur.plans import plan
from larkspur.sources.tables import Tables


def net() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def cents(x: Column, digits: int = 2) -> Column:
    return F.round(x, digits)


def offers(t: Tables, parts: DataFrame | None = None) -> DataFrame:
    """Offers of all parts, or of some only: these are filtered before the aggregation."""
    rows = t.lineitem.where("l_quantity > 0")
    rows = rows if parts is None else semi(rows, parts, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("l_partkey").alias("ps_part"), F.col("l_suppkey").alias("ps_supp")).agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("ps_cost"), F.sum("l_quantity").alias("ps_qty"))


_OFFERS = "offers as (select l_partkey as ps_part, l_suppkey as ps_supp, min(l_extendedprice / l_quantity) as ps_cost, sum(l_quantity) as ps_qty from lineitem where l_quantity > 0 group by all)"


@plan("""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) qty, round(sum(l_extendedprice), 2) base, round(sum(l_extendedprice - l_extendedprice * l_discount), 2) discounted,
round(sum((l_extendedprice - l_extendedprice * l_discount) * (l_tax + 1)), 2) charged, round(avg(l_quantity), 4) mean_qty, round(avg(l_extendedprice), 4) mean_price, round(avg(l_discount), 4) mean_discount, count(*) n
from lineitem where l_shipdate <= timestamp '2001-07-01' group by all""")
def q01_pricing_summary(t: Tables) -> DataFrame:
    rows = t.lineitem.where(F.col("l_shipdate") <= ts("2001-07-01"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        cents(F.sum("l_quantity")).alias("qty"), cents(F.sum("l_extendedprice")).alias("base"), cents(F.sum(net())).alias("discounted"), cents(F.sum(net() * (1 + F.col("l_tax")))).alias("charged"),
        F.round(F.avg("l_quantity"), 4).alias("mean_qty"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"), F.round(F.avg("l_discount"), 4).alias("mean_discount"), F.count(F.lit(1)).alias("n"),
    )


def region_suppliers(t: Tables, region: str) -> DataFrame:
    nations = semi(t.nation, t.region.where(F.col("r_name") == region), F.col("n_regionkey") == F.col("r_regionkey"))
    return equi_join(t.supplier, nations, F.col("s_nationkey") == F.col("n_nationkey"))


@plan(f"""with {_OFFERS}, local as (select * from offers, supplier, nation, region where ps_supp = s_suppkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'EUROPE'),
best as (select ps_part as bp, min(ps_cost) as bc from local group by ps_part)
select s_acctbal, s_name, n_name, p_partkey, p_brand, round(ps_cost, 4) as ps_cost from part, local, best where p_partkey = ps_part and bp = ps_part and bc = ps_cost and p_size < 10 and p_type = 'SMALL'
order by s_acctbal desc, n_name, s_name, p_partkey limit 100""")
def q02_minimum_cost_supplier(t: Tables) -> DataFrame:
    parts = t.part.where("p_size < 10 and p_type = 'SMALL'")
    local = equi_join(offers(t, parts), region_suppliers(t, "EUROPE"), F.col("ps_supp") == F.col("s_suppkey"))
    best = local.withColumn("bc", F.min("ps_cost").over(Window.partitionBy("ps_part"))).where("ps_cost = bc")
    found = equi_join(best, parts, F.col("ps_part") == F.col("p_partkey"))
    return found.orderBy(F.desc("s_acctbal"), "n_name", "s_name", "p_partkey").limit(100).select("s_acctbal", "s_name", "n_name", "p_partkey", "p_brand", F.round("ps_cost", 4).alias("ps_cost"))


@plan("""select o_orderkey, o_orderdate, round(sum(l_extendedprice - l_extendedprice * l_discount), 2) as value from lineitem join orders on o_orderkey = l_orderkey join customer on o_custkey = c_custkey
where c_mktsegment = 'BUILDING' and o_orderdate < timestamp '1998-03-15' and l_shipdate > timestamp '1998-03-15' group by all order by value desc, o_orderdate, o_orderkey limit 10""")
def q03_shipping_priority(t: Tables) -> DataFrame:
    wanted = semi(t.orders.where(F.col("o_orderdate") < ts("1998-03-15")), t.customer.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"))
    rows = equi_join(t.lineitem.where(F.col("l_shipdate") > ts("1998-03-15")), wanted, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("o_orderkey", "o_orderdate").agg(cents(F.sum(net())).alias("value")).orderBy(F.desc("value"), "o_orderdate", "o_orderkey").limit(10)


@plan("""select o_orderpriority, count(*) as n from orders o where o_orderdate >= timestamp '1997-07-01' and o_orderdate < timestamp '1997-10-01'
and exists (from lineitem l where l.l_orderkey = o.o_orderkey and l_shipdate > o_orderdate + interval 60 day) group by 1""")
def q04_order_priority(t: Tables) -> DataFrame:
    o = t.orders.where((F.col("o_orderdate") >= ts("1997-07-01")) & (F.col("o_orderdate") < ts("1997-10-01")))
    late = o.join(t.lineitem, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("l_shipdate") > F.col("o_orderdate") + F.expr("interval 60 days")), "left_semi")
    return late.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@plan("""select n_name, round(sum(l_extendedprice - l_extendedprice * l_discount), 2) as value from region join nation on r_regionkey = n_regionkey join supplier on n_nationkey = s_nationkey
join lineitem on s_suppkey = l_suppkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey and c_nationkey = s_nationkey
where r_name = 'ASIA' and year(o_orderdate) = 1997 group by n_name""")
def q05_local_supplier_volume(t: Tables) -> DataFrame:
    o = t.orders.where((F.col("o_orderdate") >= ts("1997-01-01")) & (F.col("o_orderdate") < ts("1998-01-01")))
    oc = equi_join(o, t.customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = equi_join(t.lineitem, region_suppliers(t, "ASIA"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = equi_join(rows, oc, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return rows.groupBy("n_name").agg(cents(F.sum(net())).alias("value"))


@plan("""select round(sum(l_discount * l_extendedprice), 2) as gain from lineitem where year(l_shipdate) = 1996 and l_discount between 0.03 and 0.07 and l_quantity < 24""")
def q06_forecast_revenue(t: Tables) -> DataFrame:
    rows = t.lineitem.where((F.col("l_shipdate") >= ts("1996-01-01")) & (F.col("l_shipdate") < ts("1997-01-01")) & F.col("l_discount").between(0.03, 0.07) & (F.col("l_quantity") < 24))
    return rows.agg(cents(F.sum(F.col("l_extendedprice") * F.col("l_discount"))).alias("gain"))


@plan("""select a.n_name as seller, b.n_name as buyer, year(l_shipdate)::int as y, round(sum(l_extendedprice - l_extendedprice * l_discount), 2) as value from lineitem
join supplier on l_suppkey = s_suppkey join nation a on s_nationkey = a.n_nationkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation b on c_nationkey = b.n_nationkey
where (a.n_name, b.n_name) in (('NATION_3', 'NATION_7'), ('NATION_7', 'NATION_3')) and l_shipdate between timestamp '1996-01-01' and timestamp '1997-12-31' group by all""")
def q07_volume_shipping(t: Tables) -> DataFrame:
    pair = t.nation.where(F.col("n_name").isin("NATION_3", "NATION_7"))
    sellers = equi_join(t.supplier, pair, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("seller"))
    buyers = equi_join(t.customer, pair, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("buyer"))
    rows = equi_join(t.lineitem.where(F.col("l_shipdate").between(ts("1996-01-01"), ts("1997-12-31"))), sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    bought = equi_join(t.orders, buyers, F.col("o_custkey") == F.col("c_custkey"))
    rows = equi_join(rows, bought, F.col("l_orderkey") == F.col("o_orderkey")).where("seller <> buyer")
    return rows.groupBy("seller", "buyer", F.year("l_shipdate").alias("y")).agg(cents(F.sum(net())).alias("value"))


@plan("""select year(o_orderdate)::int as y, round(sum(case when s.n_name = 'NATION_8' then l_extendedprice - l_extendedprice * l_discount else 0 end) / sum(l_extendedprice - l_extendedprice * l_discount), 6) as share
from part join lineitem on p_partkey = l_partkey join supplier on l_suppkey = s_suppkey join nation s on s_nationkey = s.n_nationkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
join nation c on c_nationkey = c.n_nationkey join region on c.n_regionkey = r_regionkey where r_name = 'AMERICA' and p_type = 'ECONOMY' and o_orderdate between timestamp '1996-01-01' and timestamp '1998-12-31' group by 1""")
def q08_market_share(t: Tables) -> DataFrame:
    here = semi(t.nation, t.region.where("r_name = 'AMERICA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    buyers = semi(t.customer, here, F.col("c_nationkey") == F.col("n_nationkey"))
    o = semi(t.orders.where(F.col("o_orderdate").between(ts("1996-01-01"), ts("1998-12-31"))), buyers, F.col("o_custkey") == F.col("c_custkey"))
    sellers = equi_join(t.supplier, t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    rows = semi(t.lineitem, t.part.where("p_type = 'ECONOMY'"), F.col("l_partkey") == F.col("p_partkey"))
    rows = equi_join(equi_join(rows, o, F.col("l_orderkey") == F.col("o_orderkey")), sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(F.year("o_orderdate").alias("y")).agg(F.round(F.sum(F.when(F.col("n_name") == "NATION_8", net()).otherwise(0.0)) / F.sum(net()), 6).alias("share"))


@plan(f"""with {_OFFERS} select n_name, year(o_orderdate)::int as y, round(sum(l_extendedprice - l_extendedprice * l_discount - 0.37 * ps_cost * l_quantity), 2) as profit from part join lineitem on l_partkey = p_partkey
join offers on ps_part = l_partkey and ps_supp = l_suppkey join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey join orders on o_orderkey = l_orderkey where p_name like '%widget%' group by all""")
def q09_product_profit(t: Tables) -> DataFrame:
    parts = t.part.where(F.col("p_name").contains("widget"))
    rows = semi(t.lineitem, parts, F.col("l_partkey") == F.col("p_partkey"))
    sellers = equi_join(t.supplier, t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    rows = equi_join(rows, offers(t, parts), (F.col("l_partkey") == F.col("ps_part")) & (F.col("l_suppkey") == F.col("ps_supp")))
    rows = equi_join(equi_join(rows, sellers, F.col("l_suppkey") == F.col("s_suppkey")), t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("n_name", F.year("o_orderdate").alias("y")).agg(cents(F.sum(net() - F.col("ps_cost") * 0.37 * F.col("l_quantity"))).alias("profit"))


@plan("""select c_custkey, c_name, n_name, c_acctbal, round(sum(l_extendedprice - l_extendedprice * l_discount), 2) as lost from lineitem join orders on l_orderkey = o_orderkey join customer on c_custkey = o_custkey join nation on c_nationkey = n_nationkey
where l_returnflag = 'R' and o_orderdate >= timestamp '1996-10-01' and o_orderdate < timestamp '1997-01-01' group by all order by lost desc, c_custkey limit 20""")
def q10_returned_items(t: Tables) -> DataFrame:
    o = t.orders.where((F.col("o_orderdate") >= ts("1996-10-01")) & (F.col("o_orderdate") < ts("1997-01-01")))
    rows = equi_join(t.lineitem.where("l_returnflag = 'R'"), o, F.col("l_orderkey") == F.col("o_orderkey"))
    per = rows.groupBy("o_custkey").agg(cents(F.sum(net())).alias("lost"))
    named = equi_join(equi_join(per, t.customer, F.col("o_custkey") == F.col("c_custkey")), t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.orderBy(F.desc("lost"), "c_custkey").limit(20).select("c_custkey", "c_name", "n_name", "c_acctbal", "lost")


@plan(f"""with {_OFFERS}, w as (select ps_part, round(0.9137 * sum(ps_cost * ps_qty), 4) as worth from offers join supplier on ps_supp = s_suppkey where s_nationkey < 5 group by ps_part)
select ps_part, worth from w where worth > (select sum(worth) * 0.0004 from w)""")
def q11_important_stock(t: Tables) -> DataFrame:
    held = semi(offers(t), t.supplier.where("s_nationkey < 5"), F.col("ps_supp") == F.col("s_suppkey"))
    worth = held.groupBy("ps_part").agg(cents(0.9137 * F.sum(F.col("ps_cost") * F.col("ps_qty")), 4).alias("worth"))
    total = worth.agg((F.sum("worth") * 0.0004).alias("least"))  # one row
    return worth.join(F.broadcast(total), F.col("worth") > F.col("least")).select("ps_part", "worth")


@plan("""select l_returnflag, count(*) filter (o_orderpriority < '3') as urgent, count(*) filter (o_orderpriority >= '3') as other from lineitem join orders on o_orderkey = l_orderkey
where l_returnflag in ('A', 'N') and l_shipdate > o_orderdate + interval 30 day and year(l_shipdate) = 1997 group by l_returnflag""")
def q12_shipping_modes(t: Tables) -> DataFrame:
    rows = t.lineitem.where(F.col("l_returnflag").isin("A", "N") & (F.col("l_shipdate") >= ts("1997-01-01")) & (F.col("l_shipdate") < ts("1998-01-01")))
    rows = rows.join(t.orders, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") > F.col("o_orderdate") + F.expr("interval 30 days")))
    return rows.groupBy("l_returnflag").agg(F.count_if(F.col("o_orderpriority") < "3").alias("urgent"), F.count_if(F.col("o_orderpriority") >= "3").alias("other"))


@plan("""select n, count(*) as customers from (select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey and o_orderpriority <> '1-URGENT' group by c_custkey) group by n""")
def q13_customer_distribution(t: Tables) -> DataFrame:
    per = t.orders.where("o_orderpriority <> '1-URGENT'").groupBy("o_custkey").agg(F.count("o_orderkey").alias("k"))
    counts = t.customer.select("c_custkey").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.coalesce("k", F.lit(0)).alias("n"))
    return counts.groupBy("n").agg(F.count(F.lit(1)).alias("customers"))


@plan("""select round(100 * sum(case when p_type = 'PROMO' then l_extendedprice - l_extendedprice * l_discount else 0 end) / sum(l_extendedprice - l_extendedprice * l_discount), 6) as share
from lineitem join part on l_partkey = p_partkey where l_shipdate >= timestamp '1997-09-01' and l_shipdate < timestamp '1997-10-01'""")
def q14_promotion_effect(t: Tables) -> DataFrame:
    rows = equi_join(t.lineitem.where((F.col("l_shipdate") >= ts("1997-09-01")) & (F.col("l_shipdate") < ts("1997-10-01"))), t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.agg(F.round(F.sum(F.when(F.col("p_type") == "PROMO", net()).otherwise(0.0)) * 100 / F.sum(net()), 6).alias("share"))


@plan("""with r as (select l_suppkey, round(sum(l_extendedprice - l_extendedprice * l_discount), 2) as value from lineitem where l_shipdate >= timestamp '1996-01-01' and l_shipdate < timestamp '1996-04-01' group by 1)
select s_suppkey, s_name, value from supplier join r on l_suppkey = s_suppkey where value = (select max(value) from r)""")
def q15_top_supplier(t: Tables) -> DataFrame:
    value = t.lineitem.where((F.col("l_shipdate") >= ts("1996-01-01")) & (F.col("l_shipdate") < ts("1996-04-01"))).groupBy("l_suppkey").agg(cents(F.sum(net())).alias("value"))
    best = value.agg(F.max("value").alias("best"))  # one row
    top = value.join(F.broadcast(best), F.col("value") == F.col("best"))
    return equi_join(t.supplier, top, F.col("s_suppkey") == F.col("l_suppkey")).select("s_suppkey", "s_name", "value")


@plan(f"""with {_OFFERS} select p_brand, p_type, p_size, count(distinct ps_supp) as suppliers from offers join part on p_partkey = ps_part
where p_brand <> 'Brand#4' and p_type <> 'PROMO' and p_size in (3, 9, 14, 19, 23, 36, 45, 49) and ps_supp not in (select s_suppkey from supplier where s_acctbal < 0) group by all""")
def q16_part_supplier_counts(t: Tables) -> DataFrame:
    parts = t.part.where((F.col("p_brand") != "Brand#4") & (F.col("p_type") != "PROMO") & F.col("p_size").isin(3, 9, 14, 19, 23, 36, 45, 49))
    fine = anti(offers(t), t.supplier.where("s_acctbal < 0"), F.col("ps_supp") == F.col("s_suppkey"))
    return equi_join(fine, parts, F.col("ps_part") == F.col("p_partkey")).groupBy("p_brand", "p_type", "p_size").agg(F.count_distinct("ps_supp").alias("suppliers"))


@plan("""select round(sum(l_extendedprice) / 7, 2) as yearly from lineitem l join part on p_partkey = l_partkey where p_brand in ('Brand#2', 'Brand#3') and l_quantity < (select avg(l_quantity) * 0.2 from lineitem i where i.l_partkey = p_partkey)""")
def q17_small_quantity_revenue(t: Tables) -> DataFrame:
    rows = semi(t.lineitem, t.part.where("p_brand in ('Brand#2', 'Brand#3')"), F.col("l_partkey") == F.col("p_partkey"))
    mean = rows.groupBy(F.col("l_partkey").alias("k")).agg((F.avg("l_quantity") * 0.2).alias("least"))
    small = equi_join(rows, mean, (F.col("l_partkey") == F.col("k")) & (F.col("l_quantity") < F.col("least")))
    return small.agg(cents(F.sum("l_extendedprice") / 7).alias("yearly"))


@plan("""select c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum(l_quantity) as qty from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
group by all having sum(l_quantity) > 180 order by o_totalprice desc, o_orderdate, o_orderkey limit 100""")
def q18_large_orders(t: Tables) -> DataFrame:
    big = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty")).where("qty > 180")
    rows = equi_join(equi_join(t.orders, big, F.col("o_orderkey") == F.col("l_orderkey")), t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey").limit(100).select("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "qty")


@plan("""select round(sum(l_extendedprice - l_extendedprice * l_discount), 2) as value from lineitem join part on p_partkey = l_partkey
where case p_brand when 'Brand#1' then p_size <= 15 and l_quantity between 1 and 11 when 'Brand#2' then p_size <= 25 and l_quantity between 10 and 20 when 'Brand#3' then l_quantity between 20 and 30 else false end""")
def q19_discounted_revenue(t: Tables) -> DataFrame:
    brand, size, qty = F.col("p_brand"), F.col("p_size"), F.col("l_quantity")
    fits = ((brand == "Brand#1") & (size <= 15) & qty.between(1, 11)) | ((brand == "Brand#2") & (size <= 25) & qty.between(10, 20)) | ((brand == "Brand#3") & qty.between(20, 30))
    parts = t.part.where(brand.isin("Brand#1", "Brand#2", "Brand#3"))
    return equi_join(t.lineitem.where(qty.between(1, 30)), parts, F.col("l_partkey") == F.col("p_partkey")).where(fits).agg(cents(F.sum(net())).alias("value"))


@plan(f"""with {_OFFERS}, shipped as (select l_partkey as a, l_suppkey as b, 0.5 * sum(l_quantity) as half from lineitem where year(l_shipdate) = 1997 group by all)
select s_suppkey, s_name from supplier where s_nationkey < 12 and s_suppkey in (select ps_supp from offers join shipped on a = ps_part and b = ps_supp where ps_qty > 3 * half and ps_part in (select p_partkey from part where p_name like 'red%'))""")
def q20_promotion_candidates(t: Tables) -> DataFrame:
    red = t.part.where(F.col("p_name").startswith("red"))
    year = (F.col("l_shipdate") >= ts("1997-01-01")) & (F.col("l_shipdate") < ts("1998-01-01"))
    shipped = t.lineitem.where(year).groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg((F.sum("l_quantity") * 0.5).alias("half"))
    stock = semi(offers(t), red, F.col("ps_part") == F.col("p_partkey"))
    rich = equi_join(stock, shipped, (F.col("ps_part") == F.col("a")) & (F.col("ps_supp") == F.col("b")) & (F.col("ps_qty") > 3 * F.col("half")))
    return semi(t.supplier.where("s_nationkey < 12"), rich, F.col("s_suppkey") == F.col("ps_supp")).select("s_suppkey", "s_name")


@plan("""with late as (select l_orderkey, l_suppkey, l_shipdate > o_orderdate + interval 90 day as is_late from lineitem join orders on o_orderkey = l_orderkey where o_orderstatus = 'F')
select s_name, count(*) as waits from late a join supplier on a.l_suppkey = s_suppkey where a.is_late and exists (from late b where b.l_orderkey = a.l_orderkey and b.l_suppkey <> a.l_suppkey)
and not exists (from late c where c.l_orderkey = a.l_orderkey and c.l_suppkey <> a.l_suppkey and c.is_late) group by s_name order by waits desc, s_name limit 100""")
def q21_waiting_suppliers(t: Tables) -> DataFrame:
    # One pass over an order's lines instead of two self joins: how many suppliers it has, and how many of them are late.
    done = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    rows = equi_join(t.lineitem, done, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_suppkey", (F.col("l_shipdate") > F.col("o_orderdate") + F.expr("interval 90 days")).alias("late"))
    per = rows.groupBy("l_orderkey").agg(F.size(F.collect_set("l_suppkey")).alias("suppliers"), F.collect_set(F.when(F.col("late"), F.col("l_suppkey"))).alias("late_ones"), F.count_if("late").alias("waits"))
    alone = per.where("suppliers > 1 and size(late_ones) = 1").select(F.col("late_ones")[0].alias("k"), "waits")
    sums = alone.groupBy("k").agg(F.sum("waits").alias("waits"))
    return equi_join(sums, t.supplier, F.col("k") == F.col("s_suppkey")).orderBy(F.desc("waits"), "s_name").limit(100).select("s_name", "waits")


@plan("""with c as (select * from customer where c_nationkey in (1, 3, 5, 8, 13)) select c_nationkey, count(*) as customers, round(sum(c_acctbal), 2) as balance from c
where c_acctbal > (select avg(c_acctbal) from c where c_acctbal > 0) and c_custkey not in (select o_custkey from orders where o_orderdate >= timestamp '2000-06-01') group by 1""")
def q22_sales_opportunity(t: Tables) -> DataFrame:
    c = t.customer.where(F.col("c_nationkey").isin(1, 3, 5, 8, 13))
    mean = c.where("c_acctbal > 0").agg(F.avg("c_acctbal").alias("mean"))  # one row
    rich = c.join(F.broadcast(mean), F.col("c_acctbal") > F.col("mean"))
    quiet = not_in(rich, "c_custkey", t.orders.where(F.col("o_orderdate") >= ts("2000-06-01")).select("o_custkey"))
    return quiet.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), cents(F.sum("c_acctbal")).alias("balance"))


@plan("""select year(o_orderdate)::int as y, n_name, p_brand, round(sum(l_extendedprice - l_extendedprice * l_discount), 2) as value from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA' and p_brand in ('Brand#1', 'Brand#2') group by all""")
def star_schema_revenue(t: Tables) -> DataFrame:
    """A star join: one fact table, filtered dimensions first."""
    sellers = region_suppliers(t, "ASIA").select("s_suppkey", "n_name")
    rows = equi_join(t.lineitem, sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = equi_join(rows, t.part.where("p_brand in ('Brand#1', 'Brand#2')").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    rows = equi_join(rows, t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.year("o_orderdate").alias("y"), "n_name", "p_brand").agg(cents(F.sum(net())).alias("value"))
