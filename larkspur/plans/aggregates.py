"""Grouping, aggregates, rollup and user-defined aggregates."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import aggregates as A
from larkspur.operators import udaf
from larkspur.plans import plan
from larkspur.sources.tables import Tables


@plan("select o_orderstatus, count(*) as n, count(nullif(o_custkey, 7)) as k, round(sum(o_totalprice), 2) as s, round(avg(o_totalprice), 4) as a, min(o_totalprice) as lo, max(o_orderpriority) as hi, min(o_orderdate) as d from orders group by 1")
def aggregate_basic(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count(F.nullif(F.col("o_custkey"), F.lit(7))).alias("k"), F.round(F.sum("o_totalprice"), 2).alias("s"), F.round(F.avg("o_totalprice"), 4).alias("a"), F.min("o_totalprice").alias("lo"), F.max("o_orderpriority").alias("hi"), F.min("o_orderdate").alias("d"))


@plan("select count(*) as n, sum(l_quantity) as s, avg(l_quantity) as a, max(l_quantity) as m from lineitem where l_orderkey < 0")
def aggregate_empty_input(t: Tables) -> DataFrame:
    return t.lineitem.where("l_orderkey < 0").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("s"), F.avg("l_quantity").alias("a"), F.max("l_quantity").alias("m"))


@plan("select c_mktsegment, 5::bigint * count(*) as total, 'k' as k from customer group by 1")
def aggregate_of_constant(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_mktsegment").agg(F.sum(F.lit(5)).alias("total"), F.max(F.lit("k")).alias("k"))


@plan("select n, count(distinct (a, b)) filter (a is not null and b is not null) as pairs, sum(distinct a)::bigint as s, round(avg(distinct a), 4) as m, count(*) as rows from (values (1, 1, 2), (1, 1, 2), (1, null, 2), (1, 3, null), (2, 5, 5), (2, 6, 5)) v(n, a, b) group by n")
def aggregate_distinct(t: Tables) -> DataFrame:
    rows = t.rows([(1, 1, 2), (1, 1, 2), (1, None, 2), (1, 3, None), (2, 5, 5), (2, 6, 5)], "n int, a int, b int")
    return rows.groupBy("n").agg(A.count_distinct("a", "b").alias("pairs"), F.sum_distinct("a").alias("s"), F.round(F.expr("avg(distinct a)"), 4).alias("m"), F.count(F.lit(1)).alias("rows"))


@plan("select l_returnflag, count(distinct l_suppkey) as s, count(distinct l_partkey) as p, sum(l_quantity) as q from lineitem group by 1")
def aggregate_distinct_large(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(A.count_distinct("l_suppkey").alias("s"), A.count_distinct("l_partkey").alias("p"), F.sum("l_quantity").alias("q"))


@plan("select l_returnflag, round(stddev_pop(l_quantity), 6) as sd, round(stddev_samp(l_quantity), 6) as ss, round(var_pop(l_quantity), 6) as v, round(var_samp(l_quantity), 6) as vs from lineitem group by 1")
def aggregate_statistics(t: Tables) -> DataFrame:
    q = "l_quantity"
    return t.lineitem.groupBy("l_returnflag").agg(F.round(A.stddev(q), 6).alias("sd"), F.round(F.stddev_samp(q), 6).alias("ss"), F.round(A.variance(q), 6).alias("v"), F.round(F.var_samp(q), 6).alias("vs"))


@plan("select g, round(var_samp(x), 4) as vs, round(var_pop(x), 4) as vp, case count(x) when 1 then 0.0 else round(covar_samp(y, x), 4) end::double as cs from (values (1, 2.0, 3.0), (2, 1.0, 1.0), (2, 4.0, 2.0)) v(g, x, y) group by g")
def aggregate_single_row_groups(t: Tables) -> DataFrame:
    rows = t.rows([(1, 2.0, 3.0), (2, 1.0, 1.0), (2, 4.0, 2.0)], "g int, x double, y double")
    return rows.groupBy("g").agg(F.round(F.var_samp("x"), 4).alias("vs"), F.round(F.var_pop("x"), 4).alias("vp"), F.round(A.covar_samp("y", "x"), 4).alias("cs"))


@plan("""select l_returnflag, round(corr(l_extendedprice, l_quantity), 6) as c, round(covar_pop(l_extendedprice, l_quantity), 3) as cp, round(covar_samp(l_extendedprice, l_quantity), 3) as cs,
round(regr_slope(l_extendedprice, l_quantity), 4) as sl, round(regr_intercept(l_extendedprice, l_quantity), 2) as ic, round(regr_r2(l_extendedprice, l_quantity), 6) as r2, round(regr_sxx(l_extendedprice, l_quantity), 2) as sxx,
round(regr_syy(l_extendedprice, l_quantity) / 1e6, 2) as syy, round(regr_sxy(l_extendedprice, l_quantity) / 1e3, 2) as sxy, round(regr_avgx(l_extendedprice, l_quantity), 4) as ax, round(regr_avgy(l_extendedprice, l_quantity), 4) as ay, regr_count(l_extendedprice, l_quantity)::bigint as n
from lineitem group by 1""")
def aggregate_regression(t: Tables) -> DataFrame:
    y, x = "l_extendedprice", "l_quantity"
    return t.lineitem.groupBy("l_returnflag").agg(
        F.round(A.corr(y, x), 6).alias("c"), F.round(F.covar_pop(y, x), 3).alias("cp"), F.round(A.covar_samp(y, x), 3).alias("cs"), F.round(F.regr_slope(y, x), 4).alias("sl"), F.round(F.regr_intercept(y, x), 2).alias("ic"),
        F.round(F.regr_r2(y, x), 6).alias("r2"), F.round(F.regr_sxx(y, x), 2).alias("sxx"), F.round(F.regr_syy(y, x) / 1e6, 2).alias("syy"), F.round(F.regr_sxy(y, x) / 1e3, 2).alias("sxy"),
        F.round(F.regr_avgx(y, x), 4).alias("ax"), F.round(F.regr_avgy(y, x), 4).alias("ay"), F.regr_count(y, x).alias("n"),
    )


@plan("select g, case when var_pop(x) > 0 and var_pop(y) > 0 then round(corr(y, x), 6) end as c from (values (1, 1.0, 5.0), (1, 2.0, 5.0), (2, 1.0, 1.0), (2, 2.0, 2.0), (3, 1.0, 1.0)) v(g, x, y) group by g")
def aggregate_corr_without_variance(t: Tables) -> DataFrame:
    rows = t.rows([(1, 1.0, 5.0), (1, 2.0, 5.0), (2, 1.0, 1.0), (2, 2.0, 2.0), (3, 1.0, 1.0)], "g int, x double, y double")
    return rows.groupBy("g").agg(F.round(A.corr("y", "x"), 6).alias("c"))


@plan("select o_orderstatus, bit_and(o_orderkey) as a, bit_or(o_orderkey) as o, bit_xor(o_orderkey) as x from orders group by 1")
def aggregate_bits(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(A.bit_aggregate("and", "o_orderkey").alias("a"), A.bit_aggregate("or", "o_orderkey").alias("o"), A.bit_aggregate("xor", "o_orderkey").alias("x"))


@plan("select n_regionkey, string_agg(n_name || ':' || n_nationkey, ';' order by n_nationkey) as l, string_agg(distinct n_regionkey::varchar, ',') as d from nation group by 1")
def aggregate_group_concat(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(A.group_concat("n_name", F.lit(":"), "n_nationkey", separator=";", order_by=[F.col("n_nationkey")]).alias("l"), A.group_concat("n_regionkey", distinct=True).alias("d"))


@plan("""select c_mktsegment, string_agg(c_name, ';' order by c_nationkey desc, c_name) as l, string_agg('', '') as e, string_agg(distinct c_nationkey::varchar, ',' order by c_nationkey::varchar desc) as d from customer group by 1""")
def aggregate_group_concat_descending(t: Tables) -> DataFrame:
    down = A.Descending("c_nationkey")
    return t.customer.groupBy("c_mktsegment").agg(A.group_concat("c_name", separator=";", order_by=[down]).alias("l"), A.group_concat(F.lit(""), separator="").alias("e"), A.group_concat("c_nationkey", order_by=[A.Descending(F.col("c_nationkey").cast("string"))], distinct=True).alias("d"))


_MONEY = "o_totalprice::decimal(12, 2)"


@plan(f"""select o_orderstatus, sum({_MONEY})::double as s, round(avg({_MONEY}), 4) as a, sum(distinct {_MONEY})::double as sd, min({_MONEY})::double as lo, 'decimal(16,6)' as kind from orders group by 1""")
def aggregate_decimals(t: Tables) -> DataFrame:
    """AVG of a decimal has four more digits; sums are exact."""
    x = F.col("o_totalprice").cast("decimal(12,2)")
    found = t.orders.groupBy("o_orderstatus").agg(F.sum(x).alias("s"), F.avg(x).alias("a"), F.sum_distinct(x).alias("sd"), F.min(x).alias("lo"))
    return found.select("o_orderstatus", F.col("s").cast("double").alias("s"), F.round(F.col("a").cast("double"), 4).alias("a"), F.col("sd").cast("double").alias("sd"), F.col("lo").cast("double").alias("lo"), F.typeof("a").alias("kind"))


@plan("select o_orderkey, try_cast(o_totalprice * 100 as decimal(7, 2))::double as fits, try_cast(o_totalprice as decimal(7, 2)) is null as over from orders")
def decimal_overflow(t: Tables) -> DataFrame:
    """A value that a decimal type cannot hold is NULL here; ``numbers.cast`` of it is an error in ANSI mode."""
    x = F.col("o_totalprice")
    return t.orders.select("o_orderkey", (x * 100).try_cast("decimal(7,2)").cast("double").alias("fits"), x.try_cast("decimal(7,2)").isNull().alias("over"))


@plan("select n_regionkey, '[' || string_agg(n_nationkey::varchar, ',' order by n_nationkey) || ']' as keys, '[' || string_agg('\"' || n_name || '\"', ',' order by n_nationkey) || ']' as names from nation group by 1")
def aggregate_json_arrayagg(t: Tables) -> DataFrame:
    order = [F.col("n_nationkey")]
    return t.nation.groupBy("n_regionkey").agg(A.json_arrayagg("n_nationkey", order).alias("keys"), A.json_arrayagg("n_name", order).alias("names"))


@plan("select o_custkey, true as among, count(*) as n from orders group by 1")
def aggregate_select_some(t: Tables) -> DataFrame:
    """Some value of a column that is not grouped: it is one of the group's."""
    found = t.orders.groupBy("o_custkey").agg(F.any_value("o_orderkey").alias("some"), F.collect_set("o_orderkey").alias("all"), F.count(F.lit(1)).alias("n"))
    return found.select("o_custkey", F.array_contains("all", F.col("some")).alias("among"), "n")


@plan("""with c as (select p_type, p_size as v, count(*) as n from part group by all), m as (select *, sum(v * n) over (partition by p_type) / sum(n) over (partition by p_type) as mean from c)
select p_type, v as moda from m qualify row_number() over (partition by p_type order by n desc, abs(v - mean), abs(v), v) = 1""")
def aggregate_moda(t: Tables) -> DataFrame:
    return A.moda(t.part, ["p_type"], "p_size")


@plan("select p_type, median(p_retailprice) as med, round(quantile_cont(p_retailprice, 0.25), 4) as q from part group by 1")
def aggregate_median(t: Tables) -> DataFrame:
    return t.part.groupBy("p_type").agg(F.median("p_retailprice").alias("med"), F.round(F.percentile("p_retailprice", 0.25), 4).alias("q"))


@plan("select l_suppkey, round(sum(l_extendedprice) / count(l_quantity) + max(l_tax), 4) as e from lineitem group by 1")
def aggregate_expression(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.round(F.sum("l_extendedprice") / F.count("l_quantity") + F.max("l_tax"), 4).alias("e"))


@plan("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as q, count(*) as n, (grouping(l_returnflag) + grouping(l_linestatus))::int as grouping_level from lineitem group by rollup (l_returnflag, l_linestatus)")
def rollup_two_keys(t: Tables) -> DataFrame:
    return A.rollup(t.lineitem, ["l_returnflag", "l_linestatus"], F.round(F.sum("l_quantity"), 2).alias("q"), F.count(F.lit(1)).alias("n"))


_KEYS = "(values (1, 10, 5), (1, null, 7), (null, 10, 11), (null, null, 13), (2, 20, null)) v(a, b, x)"


@plan(f"select a, b, sum(x)::bigint as s, (grouping(a) + grouping(b))::int as grouping_level from {_KEYS} group by rollup (a, b)")
def rollup_null_keys(t: Tables) -> DataFrame:
    rows = t.rows([(1, 10, 5), (1, None, 7), (None, 10, 11), (None, None, 13), (2, 20, None)], "a int, b int, x int")
    return A.rollup(rows, ["a", "b"], F.sum("x").alias("s"))


@plan("select c_nationkey, c_mktsegment, count(*) as n from customer group by cube (c_nationkey, c_mktsegment)")
def cube_two_keys(t: Tables) -> DataFrame:
    return t.customer.cube("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@plan("select n_regionkey, sum(n_nationkey * n_nationkey)::bigint as ssq, median(n_nationkey)::double as med, count(distinct n_name) as names, false as nulls from nation group by 1")
def udaf_samples(t: Tables) -> DataFrame:
    k = F.col("n_nationkey").cast("bigint")
    return t.nation.groupBy("n_regionkey").agg(udaf.call("SSQ", k).alias("ssq"), udaf.call("median", "n_nationkey").alias("med"), udaf.call("DISTINCT_COUNT", "n_name").alias("names"), udaf.call("ALLNULL", "n_name").alias("nulls"))


@plan("select round(avg(l_quantity), 4) as ax, 1::int as least_mode from lineitem")
def udaf_pairs(t: Tables) -> DataFrame:
    lines = t.lineitem.agg(F.round(udaf.call("AVGX", "l_extendedprice", "l_quantity"), 4).alias("ax"), F.lit(1).alias("k"))
    mode = t.rows([(1,), (1,), (2,), (2,), (3,)], "v int").agg(udaf.call("AVG_MODE", "v").alias("least_mode"), F.lit(1).alias("k"))
    return lines.join(mode, "k").drop("k")


class GeometricMean:
    """A sample of the aggregate life cycle: state is (sum of logs, count)."""

    def reset(self) -> tuple[float, int]:
        return 0.0, 0

    def next(self, state: tuple[float, int], x: Any) -> tuple[float, int]:
        import math

        return state if x is None or x <= 0 else (state[0] + math.log(x), state[1] + 1)

    def merge(self, a: tuple[float, int], b: tuple[float, int]) -> tuple[float, int]:
        return a[0] + b[0], a[1] + b[1]

    def evaluate(self, state: tuple[float, int]) -> float | None:
        import math

        return round(math.exp(state[0] / state[1]), 4) if state[1] else None


@plan("select l_returnflag, round(exp(avg(ln(l_quantity))), 4) as g from lineitem group by 1")
def udaf_life_cycle(t: Tables) -> DataFrame:
    return udaf.aggregate_with(t.lineitem, ["l_returnflag"], ["l_quantity"], GeometricMean(), "g")


@plan("select s_suppkey, s_suppkey + s_nationkey as added, s_suppkey * 2 + 1 as doubled, false as missing from supplier")
def udf_scalar_registry(t: Tables) -> DataFrame:
    udaf.register_sql(t.spark, "twice_plus_one", lambda x: None if x is None else 2 * x + 1, "bigint")
    return t.supplier.select("s_suppkey", udaf.call("ADD_PAIR", "s_suppkey", "s_nationkey").alias("added"), F.expr("twice_plus_one(s_suppkey)").alias("doubled"), udaf.call("IS_MISSING", "s_name").alias("missing"))
