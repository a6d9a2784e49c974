"""Changes of Parquet tables by copy on write: a version is a list of folders, in one small file of its own.

New folders are written beside the old ones and count once a version file names them. That file is
written under another name and renamed, and no version file is ever replaced: a reader never sees
half a change, a failed one (at any moment) leaves the table as it was, of two writers one fails,
and rollback points back. Inserts only add a folder and dropped partitions a note; updates and
deletes write the table anew.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larkspur.session import cut


class ConcurrentChange(RuntimeError):
    """Another writer has made the version that a change was to make; the change is not done."""


class VersionedTable:
    """A table whose every change is a new version; optionally split into partitions by a column."""

    def __init__(self, spark: SparkSession, path: str, partition_by: str | None = None):
        self.spark, self.path, self.partition_by = spark, path, partition_by
        self._jvm = spark.sparkContext._jvm
        self._base = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _read_text(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._base):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._base)]
        return sorted(int(n[8:-5]) for n in names if n.startswith("version-") and n.endswith(".json"))

    def _load(self, version: int) -> dict:
        return json.loads(self._read_text(f"version-{version:09d}.json"))

    def state(self) -> dict:
        """The newest version: its number, the folders that make it up, the version before it, the schema, disabled and dropped partitions."""
        versions = self._versions()
        if not versions:
            raise ValueError(f"Table {self.path} does not exist")
        return self._load(versions[-1])

    def _publish(self, state: dict) -> None:
        """Writes a version file beside the others and renames it into place; a version that is there is never replaced."""
        name = f"version-{state['version']:09d}.json"
        draft = self._at(f"draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()
        if self._fs.exists(self._at(name)) or not self._fs.rename(draft, self._at(name)):
            self._fs.delete(draft, False)
            raise ConcurrentChange(f"Table {self.path} has been changed meanwhile: version {state['version']} exists")

    def _commit(self, parts: list[str] | None = None, **changes: object) -> None:
        versions = self._versions()
        old = self._load(versions[-1]) if versions else {"version": 0, "parts": [], "disabled": [], "dropped": {}, "previous": None, "schema": None}
        new = old | changes | {"version": old["version"] + 1}
        if parts is not None:
            new |= {"parts": parts, "previous": old["version"] or None, "dropped": {p: v for p, v in old["dropped"].items() if p in parts}}
        self._publish(new)

    def create(self, df: DataFrame) -> None:
        if self._versions():
            raise ValueError(f"Table {self.path} already exists")
        self._replace(df)

    def _folder(self, df: DataFrame) -> str:
        """Writes rows to a new folder, which no version has yet."""
        name = f"part-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(self.partition_by) if self.partition_by else df.write
        writer.parquet(f"{self.path}/{name}")
        return name

    def _replace(self, df: DataFrame) -> None:
        self._commit([self._folder(df)], schema=df.schema.json())

    def read(self, hidden: bool = False) -> DataFrame:
        """The current rows; those of disabled partitions only with ``hidden``."""
        state = self.state()
        schema = StructType.fromJson(json.loads(state["schema"]))
        reader = self.spark.read.schema(schema)
        if self.partition_by is None:
            df = reader.parquet(*[f"{self.path}/{p}" for p in state["parts"]])  # one scan, however many inserts there were
        else:
            df = reduce(lambda a, b: a.unionByName(b), [self._without(reader.parquet(f"{self.path}/{p}"), state["dropped"].get(p, [])) for p in state["parts"]]).select(*schema.names)
        return df if hidden else self._without(df, state["disabled"])

    def _without(self, df: DataFrame, values: list[str]) -> DataFrame:
        key = F.col(self.partition_by) if self.partition_by else None
        return df.where(~key.cast("string").isin(values) | key.isNull()) if values else df

    def insert(self, rows: DataFrame, **changes: object) -> None:
        """Adds a folder; nothing that is there is read or written again."""
        state = self.state()
        typed = rows.select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromJson(json.loads(state["schema"])).fields])
        self._commit([*state["parts"], self._folder(typed)], **changes)

    def compact(self) -> None:
        """The same rows in one folder, after many inserts."""
        self._replace(self.read(hidden=True))

    def truncate(self) -> None:
        self._replace(self.read(hidden=True).limit(0))

    def delete(self, condition: Column) -> None:
        """Rows for which the condition is true go; NULL keeps them."""
        self._replace(self.read(hidden=True).where(~F.coalesce(condition, F.lit(False))))

    def delete_join(self, other: DataFrame, on: Sequence[str]) -> None:
        self._replace(self.read(hidden=True).join(other.select(*on).distinct(), list(on), "left_anti"))

    def update(self, assignments: dict[str, Column], condition: Column | None = None) -> None:
        df = self.read(hidden=True)
        test = F.coalesce(condition, F.lit(False)) if condition is not None else F.lit(True)
        self._replace(df.select(*[F.when(test, assignments[c]).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c in assignments else F.col(c) for c in df.columns]))

    def update_join(self, other: DataFrame, on: Sequence[str], assignments: dict[str, Column]) -> None:
        """Rows with a match take ``assignments`` over columns of both sides (the other's as ``src_<name>``); keys of ``other`` are unique."""
        df = self.read(hidden=True)
        src = other.select(*[F.col(c).alias(f"src_{c}") for c in other.columns], F.lit(True).alias("_hit"))
        joined = df.join(src, [F.col(k) == F.col(f"src_{k}") for k in on], "left")
        self._replace(joined.select(*[F.when(F.col("_hit"), assignments[c]).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c in assignments else F.col(c) for c in df.columns]))

    def add_column(self, name: str, kind: str, default: object = None) -> None:
        self._replace(self.read(hidden=True).withColumn(name, F.lit(default).cast(kind)))

    def drop_column(self, name: str) -> None:
        self._replace(self.read(hidden=True).drop(name))

    def rename_column(self, old: str, new: str) -> None:
        self._replace(self.read(hidden=True).withColumnRenamed(old, new))

    def rollback(self) -> None:
        """Back to the version before the last change."""
        state = self.state()
        if not state["previous"]:
            raise ValueError("nothing to roll back")
        before = self._load(state["previous"])
        kept = {k: state[k] for k in ("disabled", "batch") if k in state}
        self._publish(before | kept | {"version": state["version"] + 1})

    def partitions(self) -> DataFrame:
        """Each partition with its rows, value range of the partition column and whether it is enabled."""
        disabled = self.state()["disabled"]
        key = F.col(self.partition_by)
        return self.read(hidden=True).groupBy(key.cast("string").alias("partition")).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("enabled", ~F.col("partition").isin(disabled) if disabled else F.lit(True))

    def disable(self, *values: object) -> None:
        self._commit(disabled=sorted({*self.state()["disabled"], *map(str, values)}))

    def enable(self, *values: object) -> None:
        self._commit(disabled=sorted(set(self.state()["disabled"]) - set(map(str, values))))

    def drop_partition(self, *values: object) -> None:
        """The partitions' folders are left out from now on; nothing is read or written."""
        state, names = self.state(), {str(v) for v in values}
        dropped = {p: sorted({*state["dropped"].get(p, []), *names}) for p in state["parts"]}
        self._publish(state | {"version": state["version"] + 1, "previous": state["version"], "dropped": dropped, "disabled": sorted(set(state["disabled"]) - names)})

    def redistribute(self, files: int) -> None:
        """The same rows in so many evenly filled files."""
        self._replace(self.read(hidden=True).repartition(files))

    def drop(self) -> None:
        self._fs.delete(self._base, True)


def with_auto_increment(df: DataFrame, column: str, start: int, order: Sequence[str]) -> DataFrame:
    """Consecutive numbers from ``start`` in the given order.

    Rows are numbered within sorted ranges; a range's first number comes from the counts of the
    ranges before it (one row a range), so no task sees all rows.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    numbered = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    return numbered.join(F.broadcast(before), "_p").withColumn(column, F.col("_before") + F.col("_i") + start - 1).drop("_p", "_i", "_before")
