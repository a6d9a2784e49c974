"""User-defined functions: a registry of scalar functions and aggregates, and sample aggregates.

An aggregate is a composition of built-in aggregates where one exists. Others implement the
life cycle reset, next, merge, evaluate: batches are folded to partial states map-side, and only the
states are shuffled and merged.
"""

from __future__ import annotations

import base64
import pickle
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import Col, col
from larkspur.session import ship_package


class Aggregate(Protocol):
    def reset(self) -> Any: ...

    def next(self, state: Any, *values: Any) -> Any: ...

    def merge(self, a: Any, b: Any) -> Any: ...

    def evaluate(self, state: Any) -> Any: ...


AGGREGATES: dict[str, Callable[..., Column]] = {}
SCALARS: dict[str, Callable[..., Column]] = {}


def aggregate(name: str) -> Callable:
    def add(function: Callable[..., Column]) -> Callable[..., Column]:
        AGGREGATES[name.upper()] = function
        return function

    return add


def scalar(name: str) -> Callable:
    def add(function: Callable[..., Column]) -> Callable[..., Column]:
        SCALARS[name.upper()] = function
        return function

    return add


def call(name: str, *args: Col) -> Column:
    found = AGGREGATES.get(name.upper()) or SCALARS.get(name.upper())
    if found is None:
        raise KeyError(f"FUNCTION {name} does not exist")
    return found(*args)


def register_sql(spark: SparkSession, name: str, function: Callable, kind: str) -> None:
    """A Python function as a SQL function, evaluated over Arrow batches."""
    ship_package(spark)
    spark.udf.register(name, F.udf(function, kind, useArrow=True))


@aggregate("ALLNULL")
def allnull(*items: Col) -> Column:
    """True if every input is NULL."""
    return sum((F.count(col(i)) for i in items), F.lit(0)) == 0


@aggregate("SSQ")
def ssq(x: Col) -> Column:
    return F.sum(col(x) * col(x))


@aggregate("AVG_MODE")
def avg_mode(x: Col) -> Column:
    """The most frequent value; the smallest of several."""
    return F.mode(col(x), True)


@aggregate("AVGX")
def avgx(y: Col, x: Col) -> Column:
    """Mean of x over rows where both are known."""
    return F.regr_avgx(col(y), col(x))


@aggregate("MEDIAN")
def median(x: Col) -> Column:
    return F.median(col(x))


@aggregate("DISTINCT_COUNT")
def distinct_count(x: Col) -> Column:
    return F.count_distinct(col(x))


@scalar("ADD_PAIR")
def add_pair(a: Col, b: Col) -> Column:
    return col(a) + col(b)


@scalar("IS_MISSING")
def is_missing(a: Col) -> Column:
    return col(a).isNull()


def aggregate_with(df: DataFrame, keys: Sequence[str], values: Sequence[str], function: Aggregate, out: str, kind: str = "double") -> DataFrame:
    """Groups ``df`` by ``keys`` with a Python aggregate.

    Each Arrow batch yields one partial state for each of its groups; the states of a group are
    merged as a stream over sorted partitions, so neither side holds a group's rows.
    """
    ship_package(df.sparkSession)
    fields = df.select(*keys).schema.fields
    key_schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    names = [f.name for f in fields]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states: dict[tuple, Any] = {}
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                key = row[: len(names)]
                states[key] = function.next(states[key] if key in states else function.reset(), *row[len(names) :])
            if states:
                yield pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in states], type=batch.column(i).type) for i in range(len(names))], pa.array([base64.b64encode(pickle.dumps(s)).decode() for s in states.values()])], names=[*names, "_state"])

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done, types = None, None, [], None

        def flush() -> pa.RecordBatch:
            made = [pa.array([k[i] for k, _ in done], type=types[i]) for i in range(len(names))]
            result = pa.RecordBatch.from_arrays([*made, pa.array([v for _, v in done])], names=[*names, out])
            done.clear()
            return result

        for batch in batches:
            types = [batch.column(i).type for i in range(len(names))]
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                key, part = row[:-1], pickle.loads(base64.b64decode(row[-1]))
                if now is not None and key == now:
                    state = function.merge(state, part)
                else:
                    if now is not None:
                        done.append((now, function.evaluate(state)))
                    now, state = key, part
            if len(done) > 10_000:
                yield flush()
        if now is not None:
            done.append((now, function.evaluate(state)))
        if done:
            yield flush()

    states = df.select(*keys, *values).mapInArrow(partial, f"{key_schema}_state string")
    spread = states.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys) if keys else states.repartition(1)
    return spread.mapInArrow(final, f"{key_schema}{out} {kind}")


class WindowAggregate(Protocol):
    """An analytic aggregate: rows enter the frame by ``next`` and leave it by ``drop``."""

    def reset(self) -> Any: ...

    def next(self, state: Any, value: Any) -> Any: ...

    def drop(self, state: Any, value: Any) -> Any: ...

    def evaluate(self, state: Any) -> Any: ...


def window_with(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str], value: str, function: WindowAggregate, out: str, preceding: int | None = None, following: int = 0, kind: str = "double") -> DataFrame:
    """``df`` with ``out``, a Python analytic aggregate over ROWS ``preceding`` PRECEDING (None: unbounded) to ``following`` FOLLOWING.

    Rows stream in order through each partition; a task holds the rows of one frame (with an
    unbounded start, those that wait for followers). ``partition_by`` has a column at least. NULLs
    come first in the order and are values like others for ``function``.
    """
    ship_package(df.sparkSession)
    at = [df.columns.index(c) for c in partition_by], df.columns.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, inside, waiting, schema = None, None, deque(), deque(), None

        def close(frame_end: bool) -> Iterator[tuple]:
            """The waiting rows whose frame is complete."""
            nonlocal state
            while waiting and (frame_end or waiting[0][1] <= 0):
                row, _ = waiting.popleft()
                yield (*row, function.evaluate(state))
                # The next row's frame begins one later, once it is full.
                done[0] += 1
                if preceding is not None and done[0] > preceding:
                    state = function.drop(state, inside.popleft())

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([*[pa.array(c, f.type) for c, f in zip(columns, schema, strict=False)], pa.array(columns[-1])], names=[*schema.names, out])

        done, made = [0], []
        for batch in batches:
            schema = batch.schema
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                key = tuple(row[i] for i in at[0])
                if key != now:
                    made += close(True)
                    now, state, done[0] = key, function.reset(), 0
                    inside.clear()
                state = function.next(state, row[at[1]])
                if preceding is not None:
                    inside.append(row[at[1]])
                for w in waiting:
                    w[1] -= 1
                waiting.append([row, following])
                made += close(False)
            if len(made) > 10_000:
                yield batch_of(made)
                made = []
        made += close(True)
        if made:
            yield batch_of(made)

    rows = df.repartition(*[F.col(c) for c in partition_by]).sortWithinPartitions(*partition_by, *order_by)
    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {out} {kind}")
