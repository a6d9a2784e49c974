"""Joins, set operations, ordering and subquery forms."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.session import cut

#: A side is broadcast only when its estimate (compressed files, some times that in memory) is at most this large; above it adaptive execution decides by the size at run time.
BROADCAST_BYTES = 10 << 20


def size_in_bytes(df: DataFrame) -> int:
    """The optimiser's estimate for the plan: file sizes for scans, scaled by projections and filters."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def equi_join(left: DataFrame, right: DataFrame, on: Sequence[str] | Column | list[Column], how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hash join with the smaller side broadcast when its estimated size is at most ``limit``; else a shuffled join.

    Only sides that the join type allows are broadcast; adaptive execution splits skewed partitions of the rest.
    """
    build_right = how in ("inner", "left", "left_outer", "left_semi", "left_anti")
    build_left = how in ("inner", "right", "right_outer")
    r, s = size_in_bytes(right), size_in_bytes(left)
    if build_right and r <= limit and (r <= s or not build_left):
        right = F.broadcast(right)
    elif build_left and s <= limit:
        left = F.broadcast(left)
    return left.join(right, on, how)


#: Rows of each side in a block of ``less_join``, pairs that a task takes on average, tasks at most, bands of values.
BLOCK_ROWS, TASK_PAIRS, MOST_TASKS, BANDS = 1 << 13, 1 << 25, 10_000, 16


def less_join(left: DataFrame, right: DataFrame, keys: tuple[str, str], less: tuple[Column, Column]) -> DataFrame:
    """Inner join on equal ``keys`` where ``less[0]`` of ``left`` is less than ``less[1]`` of ``right``; column names of the sides differ.

    With few keys the pairs grow with the product of the sides, and a task for each key, or for each small file, would take
    nearly all of them. So each key's sides are cut into bands of values (bounds that both sides share) and bands into blocks of
    bounded rows by hash; tasks take pairs of blocks, as many tasks as the pairs need. Bands that cannot match are never
    paired. Only rows that are equal in all columns cannot be parted.
    """
    condition = (F.col(keys[0]) == F.col(keys[1])) & (less[0] < less[1])
    a = left.withColumn("_v", less[0]).where(F.col(keys[0]).isNotNull() & F.col("_v").isNotNull())
    b = right.withColumn("_w", less[1]).where(F.col(keys[1]).isNotNull() & F.col("_w").isNotNull())
    counted = lambda df, n, *by: df.groupBy(*by).agg(F.count(F.lit(1)).alias(n))
    sums = counted(a, "_m", F.col(keys[0]).alias("_k")).join(counted(b, "_n", F.col(keys[1]).alias("_k")), "_k")
    if (sums.agg(F.sum(F.col("_m").cast("double") * F.col("_n"))).first()[0] or 0) <= TASK_PAIRS:
        return equi_join(left, right, condition)
    bounds = sorted(set(b.agg(F.percentile_approx("_w", [i / BANDS for i in range(1, BANDS)])).first()[0]))
    band = lambda x: sum(((F.col(x) >= F.lit(v)).cast("int") for v in bounds), F.lit(0))
    a, b = a.withColumn("_i", band("_v")), b.withColumn("_j", band("_w"))
    sides = counted(a, "_m", F.col(keys[0]).alias("_k"), "_i"), counted(b, "_n", F.col(keys[1]).alias("_l"), "_j")
    blocks = cut(sides[0].join(sides[1], (F.col("_k") == F.col("_l")) & (F.col("_i") <= F.col("_j"))))
    pairs = blocks.agg(F.sum(F.col("_m").cast("double") * F.col("_n"))).first()[0] or 0
    tasks = min(max(math.ceil(pairs / TASK_PAIRS), left.sparkSession.sparkContext.defaultParallelism), MOST_TASKS)
    pieces = lambda n: F.ceil(F.col(n) / BLOCK_ROWS).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), pieces(n) - 1))
    one_of = lambda df, n: F.pmod(F.xxhash64(*df.columns), pieces(n)).cast("int")
    at = ("_k", "_i", "_p", "_j", "_q")
    meets = blocks.select("_k", "_m", "_n", F.col("_i").alias("_bi"), F.col("_j").alias("_bj"))
    x = a.join(meets, (F.col(keys[0]) == F.col("_k")) & (F.col("_i") == F.col("_bi")))
    x = x.select(*left.columns, "_v", "_k", "_i", one_of(left, "_m").alias("_p"), F.col("_bj").alias("_j"), all_of("_n").alias("_q")).repartition(tasks, *at)
    y = b.join(meets, (F.col(keys[1]) == F.col("_k")) & (F.col("_j") == F.col("_bj")))
    y = y.select(*right.columns, "_w", "_k", F.col("_bi").alias("_i"), all_of("_m").alias("_p"), "_j", one_of(right, "_n").alias("_q")).toDF(*right.columns, "_w", *[f"_r{c}" for c in at]).repartition(tasks, *[f"_r{c}" for c in at])
    same = [F.col(c) == F.col(f"_r{c}") for c in at]
    return x.join(y.hint("shuffle_hash"), [*same, F.col("_v") < F.col("_w")]).select(*left.columns, *right.columns)


def semi(left: DataFrame, right: DataFrame, on: Sequence[str] | Column) -> DataFrame:
    return equi_join(left, right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on: Sequence[str] | Column) -> DataFrame:
    return equi_join(left, right, on, "left_anti")


def not_in(left: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """NOT IN with its NULL rules: no rows if ``values`` holds a NULL, and NULL keys only pass over no values.

    The two facts about ``values`` are one-row aggregates joined to every row; the rest is an anti
    join on the key, so nothing runs as a nested loop over both sides.
    """
    name = values.columns[0]
    facts = values.agg(F.count(F.lit(1)).alias("_all"), F.count(F.col(name)).alias("_known"))
    found = values.where(F.col(name).isNotNull()).select(F.col(name).alias("_value")).distinct()
    kept = left.join(found, F.col(key) == F.col("_value"), "left_anti")
    judged = kept.join(F.broadcast(facts))  # one row
    return judged.where((F.col("_all") == 0) | ((F.col("_all") == F.col("_known")) & F.col(key).isNotNull())).drop("_all", "_known")


def scalar(df: DataFrame) -> DataFrame:
    """A one-row, one-column subquery; several rows are an error, none is NULL."""
    name = df.columns[0]
    rows = df.limit(2).agg(F.collect_list(F.struct(F.col(name).alias("v"))).alias("_v"))
    checked = F.when(F.size("_v") > 1, F.raise_error("Subquery returns more than 1 row").cast(df.schema[0].dataType)).otherwise(F.get("_v", F.lit(0))["v"])
    return rows.select(checked.alias(name))


def _common(a: T.DataType, b: T.DataType) -> T.DataType:
    """Text wins over numbers, decimals widen both ways, and otherwise the wider type."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    whole = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}
    if isinstance(a, T.StringType) or isinstance(b, T.StringType):
        return T.StringType()
    if type(a) in whole and type(b) in whole:
        return a if whole[type(a)] >= whole[type(b)] else b
    if isinstance(a, (T.FloatType, T.DoubleType)) or isinstance(b, (T.FloatType, T.DoubleType)):
        return T.DoubleType()
    if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
        ap, as_ = (a.precision, a.scale) if isinstance(a, T.DecimalType) else (whole.get(type(a), 38), 0)
        bp, bs = (b.precision, b.scale) if isinstance(b, T.DecimalType) else (whole.get(type(b), 38), 0)
        scale = max(as_, bs)
        return T.DecimalType(min(38, max(ap - as_, bp - bs) + scale), scale)
    dated = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(a, dated) and isinstance(b, dated):
        return T.TimestampNTZType()
    return T.StringType()


def union(*frames: DataFrame, distinct: bool = False) -> DataFrame:
    """UNION [ALL] by position with the warehouse's type promotion; names are those of the first branch."""
    first = frames[0]
    if any(len(f.columns) != len(first.columns) for f in frames):
        raise ValueError("The used SELECT statements have a different number of columns")
    kinds = [f.dataType for f in first.schema.fields]
    for f in frames[1:]:
        kinds = [_common(a, b.dataType) for a, b in zip(kinds, f.schema.fields, strict=True)]
    out = None
    for f in frames:
        branch = f.select(*[F.col(f"`{c}`").cast(k).alias(n) for c, k, n in zip(f.columns, kinds, first.columns, strict=True)])
        out = branch if out is None else out.union(branch)
    return out.distinct() if distinct else out


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def top(df: DataFrame, order: Sequence[Column], count: int, offset: int = 0, hidden: Sequence[str] = ()) -> DataFrame:
    """ORDER BY ... LIMIT offset, count; ``hidden`` columns only serve the order."""
    ordered = df.orderBy(*order)
    if offset:
        ordered = ordered.offset(offset)
    return ordered.limit(count).drop(*hidden)
