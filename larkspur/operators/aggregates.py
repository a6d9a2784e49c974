"""Aggregates whose rules differ from the built-ins, and grouping with rollup and mode."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import Col, col


def stddev(x: Col) -> Column:
    """The short names are the population forms here."""
    return F.stddev_pop(col(x))


def variance(x: Col) -> Column:
    return F.var_pop(col(x))


def corr(y: Col, x: Col) -> Column:
    """NULL below two pairs or where either side does not vary."""
    paired = lambda v: F.when(col(y).isNotNull() & col(x).isNotNull(), col(v).cast("double"))
    return F.try_divide(F.covar_pop(col(y), col(x)), F.stddev_pop(paired(y)) * F.stddev_pop(paired(x)))


def covar_samp(y: Col, x: Col) -> Column:
    """0, not NULL, for a single pair."""
    return F.when(F.regr_count(col(y), col(x)) == 1, 0.0).otherwise(F.covar_samp(col(y), col(x)))


@dataclass(frozen=True)
class Descending:
    """An item of ``order_by`` that falls; NULLs come last, in rising items first."""

    by: Col


def group_concat(*parts: Col, separator: str = ",", order_by: Sequence[Col | Descending] = (), distinct: bool = False) -> Column:
    """Rows with a NULL part are skipped; ties, and all rows without an order, are sorted by text so that runs agree.

    A group without values gives NULL, one of empty texts an empty text. With ``distinct`` a text
    stands where its first row in the order does.
    """
    text = F.concat(*[col(p).cast("string") for p in parts])
    falls = [isinstance(k, Descending) for k in order_by] + [False]
    keys = [col(k.by if isinstance(k, Descending) else k) for k in order_by] + [text]
    row = F.when(text.isNotNull(), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]))

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for i in range(len(keys) - 1, -1, -1):
            x, y = a[f"k{i}"], b[f"k{i}"]
            less = F.coalesce(x < y, x.isNull() & y.isNotNull())
            more = F.coalesce(x > y, y.isNull() & x.isNotNull())
            out = F.when(less, 1 if falls[i] else -1).when(more, -1 if falls[i] else 1).otherwise(out)
        return out

    rows = F.collect_set(row) if distinct else F.collect_list(row)
    texts = F.transform(F.array_sort(rows, compare) if any(falls) else F.array_sort(rows), lambda r: r[f"k{len(keys) - 1}"])
    return F.when(F.count(text) > 0, F.array_join(F.array_distinct(texts) if distinct else texts, separator))


def json_arrayagg(x: Col, order_by: Sequence[Column] = ()) -> Column:
    """NULLs are kept as null."""
    row = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(order_by)], col(x).alias("v"))
    made = F.to_json(F.transform(F.array_sort(F.collect_list(row)), lambda r: F.struct(r["v"].alias("v"))), {"ignoreNullFields": "false"})
    return F.regexp_replace(F.regexp_replace(made, r'\{"v":((?:"(?:[^"\\]|\\.)*"|[^{}"])*)\}', "$1"), r"\s+$", "")


def count_distinct(*items: Col) -> Column:
    """Rows with a NULL in any item are skipped."""
    return F.count_distinct(*[col(i) for i in items])


def moda(df: DataFrame, keys: Sequence[str], value: str, out: str = "moda") -> DataFrame:
    """The most frequent value of each group; ties go to the value nearest the group's average, then the smallest magnitude.

    Values are counted with map-side sums first, so what a window sees is one row a distinct value.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    mean = F.sum(F.col(value).cast("double") * F.col("_n")).over(group) / F.sum("_n").over(group)
    best = counted.withColumn("_gap", F.abs(F.col(value).cast("double") - mean))
    order = group.orderBy(F.desc("_n"), F.asc("_gap"), F.abs(F.col(value)).asc(), F.col(value).asc())
    found = best.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*keys, F.col(value).alias(out))
    if not keys:
        return found
    groups = df.select(*keys).distinct()
    match = groups.alias("g").join(found.alias("f"), [F.col(f"g.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys], "left")
    return match.select(*[F.col(f"g.{k}") for k in keys], F.col(f"f.{out}"))


def rollup(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """GROUP BY ... WITH ROLLUP; ``grouping_level`` (keys rolled up) tells subtotals from groups of NULL keys."""
    level = F.lit(0)
    for k in keys:
        level = level + F.grouping(k).cast("int")
    return df.rollup(*keys).agg(*aggregates, level.alias("grouping_level"))


def bit_aggregate(kind: str, x: Col) -> Column:
    """BIT_AND, BIT_OR, BIT_XOR; an empty group gives the neutral value (all bits for BIT_AND, as -1)."""
    found = {"and": F.bit_and, "or": F.bit_or, "xor": F.bit_xor}[kind](col(x).cast("bigint"))
    return F.coalesce(found, F.lit(-1 if kind == "and" else 0).cast("bigint"))
