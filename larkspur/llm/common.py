"""Shared folder, written cuts of the lineage, and small helpers of the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.session import cut, discard, discard_folder, shared_folder

__all__ = ["WORD", "cut", "discard", "discard_folder", "file_system", "free", "keep", "map_arrow", "quoted", "shared_folder"]

#: Words of every contract: runs of anything but space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def file_system(url: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri("file://" + url[5:] if url.startswith("file:/") and not url.startswith("file://") else url)


def keep(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns``; input columns of the same names (compared without case) are replaced."""
    taken = {c.lower() for c in columns}
    return df.select(*[F.col(quoted(c)) for c in df.columns if c.lower() not in taken], *[v.alias(k) for k, v in columns.items()])


def free(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores put before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` of a function of one batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out
                del batch, out
                pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)
