"""Sessions with the settings the engine is tuned for, and shipping of the package to executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def session(app: str = "larkspur", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution (coalescing, skew joins) and UTC; ``conf`` overrides, dots as ``__``."""
    settings = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.parquet.filterPushdown": "true",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Bytes of an Arrow batch to Python; Spark's own default of 64 MB, several times over in JVM and worker, is much beside a 3 GB executor.
ARROW_BYTES, _ARROW, _SPARKS_OWN = "4m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, once for each application, and bounds Arrow batches where the user has not."""
    context = spark.sparkContext
    if spark.conf.get(_ARROW, _SPARKS_OWN) == _SPARKS_OWN:
        spark.conf.set(_ARROW, ARROW_BYTES)
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    if root.suffix == ".zip" or not root.is_dir():
        return
    target = os.path.join(tempfile.mkdtemp(prefix="larkspur-"), "larkspur.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, Path(root.name) / path.relative_to(root))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in ``spark.checkpoint.dir``; it goes when the driver ends.

    Where that is unset, a session on one machine (tests) gets a temporary folder as its checkpoint
    folder; any other is refused, for executors could not read what a machine-local folder holds.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.sparkContext.setCheckpointDir(base)
    if "://" not in base:
        base = base if ":" in base.split("/", 1)[0] else "file://" + base
    folder = f"{base.rstrip('/')}/larkspur-{uuid.uuid4().hex}"
    fs, path = _hadoop(spark, folder)
    fs.deleteOnExit(path)
    return folder


def _hadoop(spark: SparkSession, url: str):
    """The file system of ``url``, whichever it is, and its path there."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(url)
    return path.getFileSystem(context._jsc.hadoopConfiguration()), path


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: lost executors cost no recomputation of what led to it.

    The shuffle files of the write are deleted when it is over. ``discard`` deletes what was written.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def discard(*cuts: DataFrame | None) -> None:
    """Deletes the files of ``cut`` frames that nothing reads any more; other frames and None are left alone."""
    for df in cuts:
        if path := getattr(df, "_cut", None):
            discard_folder(df.sparkSession, path)


def discard_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that ``shared_folder`` named."""
    fs, path = _hadoop(spark, folder)
    fs.delete(path, True)
