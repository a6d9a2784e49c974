"""Window functions that the built-ins do not offer in this form."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from larkspur.functions.text import Col, col


def count_distinct(x: Col, window: WindowSpec) -> Column:
    return F.size(F.collect_set(col(x)).over(window)).cast("bigint")


def sum_distinct(x: Col, window: WindowSpec, kind: str | None = None) -> Column:
    """NULL over no values. Integers are summed as bigint, doubles as such; ``kind``: the type to sum in, for decimals."""
    values = F.array_sort(F.collect_set(col(x)).over(window))
    zero = F.element_at(values, 1) * F.lit(0).cast("bigint") if kind is None else F.lit(0).cast(kind)
    return F.when(F.size(values) > 0, F.aggregate(values, zero, lambda a, v: a + v if kind is None else (a + v).cast(kind)))


def avg_distinct(x: Col, window: WindowSpec) -> Column:
    return F.try_divide(sum_distinct(x, window).cast("double"), count_distinct(x, window).cast("double"))


def lead(x: Col, window: WindowSpec, offset: int = 1, default: object = None, ignore_nulls: bool = False) -> Column:
    """Looks at the whole partition; a negative offset looks back. ``window`` has no frame."""
    if not ignore_nulls:
        return F.lead(col(x), offset, default).over(window)
    if offset == 0:
        return col(x)
    frame = window.rowsBetween(1, Window.unboundedFollowing) if offset > 0 else window.rowsBetween(Window.unboundedPreceding, -1)
    if offset > 0:
        found = F.nth_value(col(x), offset, True).over(frame)
    elif offset == -1:
        found = F.last(col(x), True).over(frame)
    else:
        values = F.collect_list(col(x)).over(frame)  # skips NULLs, in order
        found = F.get(values, F.size(values) + offset)
    return found if default is None else F.coalesce(found, F.lit(default))


def lag(x: Col, window: WindowSpec, offset: int = 1, default: object = None, ignore_nulls: bool = False) -> Column:
    return lead(x, window, -offset, default, ignore_nulls)


def nth_value(x: Col, n: int, window: WindowSpec, from_last: bool = False, ignore_nulls: bool = False) -> Column:
    if n < 1:
        raise ValueError("NTH_VALUE takes a positive number")
    if not from_last:
        return F.nth_value(col(x), n, ignore_nulls).over(window)
    row = F.struct(col(x).alias("v"))
    items = F.collect_list(F.when(col(x).isNotNull(), row) if ignore_nulls else row).over(window)
    return F.get(items, F.size(items) - n)["v"]


def ntile(buckets: Column | int, window: WindowSpec) -> Column:
    """The bucket count may differ by row; the first buckets take the remainder; NULL gives NULL."""
    if isinstance(buckets, int):
        if buckets < 1:
            raise ValueError("NTILE takes a positive number")
        return F.ntile(buckets).over(window).cast("bigint")
    total = F.count(F.lit(1)).over(window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    i = F.row_number().over(window) - 1
    size, extra = F.floor(total / buckets), total % buckets
    return F.when(buckets.isNull(), None).when(buckets < 1, F.raise_error("NTILE takes a positive number").cast("bigint")).when(i < extra * (size + 1), F.floor(i / (size + 1)) + 1).otherwise(F.floor((i - extra) / F.greatest(size, F.lit(1))) + 1).cast("bigint")


def rows_frame(function: str, x: Col, before: Column, after: Column, window: WindowSpec) -> Column:
    """sum, avg, min, max or count over ROWS before PRECEDING .. after FOLLOWING with offsets from columns.

    The partition's values are gathered once for each row's frame, so use it where offsets truly vary.
    """
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    items = F.collect_list(F.struct(col(x).alias("v"))).over(whole)
    i = F.row_number().over(window)
    start = F.greatest(i - before.cast("int"), F.lit(1))
    stop = i + after.cast("int")
    values = F.transform(F.filter(F.slice(items, start, F.greatest(stop - start + 1, F.lit(0))), lambda r: r["v"].isNotNull()), lambda r: r["v"].cast("double"))
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    kinds = {"count": F.size(values).cast("bigint"), "sum": F.when(F.size(values) > 0, total), "avg": F.try_divide(total, F.size(values).cast("double")), "min": F.array_min(values), "max": F.array_max(values)}
    return kinds[function]


def percentile_cont(p: float, x: Col, window: WindowSpec) -> Column:
    """Linear interpolation over the partition; NULLs do not count. One task gathers the partition; ``percentiles`` does not."""
    if not 0 <= p <= 1:
        raise ValueError("a percentile lies between 0 and 1")
    return F.percentile(col(x), p).over(window)


def median(x: Col, window: WindowSpec) -> Column:
    return percentile_cont(0.5, x, window)


def per_partition(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """SELECT DISTINCT of ``keys`` and aggregates over whole partitions by them: one row a partition.

    A window would gather each partition's rows in one task; groups are summed where the rows are.
    """
    return df.groupBy(*keys).agg(*[a.alias(name) for name, a in aggregates.items()])


def with_partition(df: DataFrame, keys: Sequence[str], found: DataFrame) -> DataFrame:
    """The rows of ``df``, each with its partition's row of ``found`` (``keys``, then others); NULL keys are a partition."""
    renamed = found.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in found.columns if c not in keys])
    return df.join(renamed, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*[f"_{k}" for k in keys])


def percentiles(df: DataFrame, keys: Sequence[str], x: str, **wanted: tuple[str, float]) -> DataFrame:
    """Percentiles of ``x`` over whole partitions, one row a partition: name=("cont" or "disc", p). NULLs do not count; a partition of NULLs has none.

    ``cont`` interpolates, ``disc`` is the smallest value whose cumulative distribution reaches p. Equal values
    are counted first, so only one row for each different value of a partition is sorted, and that with spilling.
    """
    if not all(0 <= p <= 1 for _, p in wanted.values()):
        raise ValueError("a percentile lies between 0 and 1")
    counted = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(x)
    summed = counted.select(*keys, x, F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"), F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    first = lambda test: F.min(F.when(test, F.col(x)))
    out, near = [], []
    for name, (kind, p) in wanted.items():
        if kind == "disc":
            rank = F.ceil(F.lit(Decimal(str(p))) * F.col("_all"))  # of decimals: 0.7 * 10 is 7, not a little more
            near.append(first(F.col("_upto") >= F.greatest(rank, F.lit(1))).alias(name))
            out.append(F.col(name))
        else:
            at = F.lit(float(p)) * (F.col("_all") - 1)
            near += [first(F.col("_upto") > F.floor(at)).cast("double").alias(f"_{name}_low"), first(F.col("_upto") > F.ceil(at)).cast("double").alias(f"_{name}_high"), F.first(at).alias(f"_{name}_at")]
            low, high, at = (F.col(f"_{name}_{k}") for k in ("low", "high", "at"))
            out.append(F.when((F.floor(at) == F.ceil(at)) | (low == high), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(name))
    return summed.groupBy(*keys).agg(*near).select(*keys, *out)
