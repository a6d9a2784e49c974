"""Bulk load and unload of text, binary and Parquet files."""

from __future__ import annotations

import glob
import os
import re
import shutil
import struct
import tempfile
import zipfile
from urllib.parse import urlsplit

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.session import discard_folder, shared_folder


class LoadError(ValueError):
    """More bad rows than allowed."""


def load_text(spark: SparkSession, path: str, schema: str, delimiter: str = "|", enclosed: str = "", escape: str = "\\", null: str = "\\N", skip_lines: int = 0, max_errors: int | None = None, errors_to: str | None = None, truncation_is_error: bool = False) -> DataFrame:
    """Delimited text by a fixed schema; ``skip_lines`` header lines of each file are left out.

    A row that does not fit goes to ``errors_to`` as its raw line; more of them than ``max_errors``
    is a ``LoadError``. Text longer than its varchar(n) column is cut, or counts as an error.
    """
    want = T.StructType.fromDDL(schema)
    widths = {f.name: int(re.sub(r"\D", "", f.dataType.simpleString())) for f in want.fields if isinstance(f.dataType, (T.CharType, T.VarcharType))}
    plain = T.StructType([T.StructField(f.name, T.StringType() if f.name in widths else f.dataType) for f in want.fields])
    marked = T.StructType([*plain.fields, T.StructField("_bad", T.StringType())])
    options = {"sep": delimiter, "quote": enclosed, "escape": escape, "nullValue": null, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "emptyValue": ""}
    lines = spark.read.text(path)
    if skip_lines:
        # The n-th line of a file is known from its smallest row numbers; only these are looked up.
        lines = lines.select("value", F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("_i"))
        heads = lines.groupBy("_f").agg(F.min("_i").alias("_low"))
        lines = lines.join(heads, "_f").where(F.col("_i") >= F.col("_low") + skip_lines).select("value")
    rows = lines.select(F.from_csv("value", _ddl(marked), options).alias("r"), "value").select("r.*", "value")
    too_long = F.lit(False)
    if truncation_is_error:
        for name, width in widths.items():
            too_long = too_long | (F.char_length(name) > width)
    bad = F.col("_bad").isNotNull() | F.coalesce(too_long, F.lit(False))
    if errors_to or max_errors is not None:
        wrong = rows.where(bad).select("value")
        if errors_to:
            wrong.write.mode("append").text(errors_to)
        if max_errors is not None and wrong.limit(max_errors + 1).count() > max_errors:
            raise LoadError(f"more than {max_errors} rows of {path} do not fit")
    good = rows.where(~bad)
    return good.select(*[F.left(F.col(f.name), F.lit(widths[f.name])).alias(f.name) if f.name in widths else F.col(f.name) for f in plain.fields])


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def unload_text(df: DataFrame, path: str, delimiter: str = "|", enclosed: str = "", null: str = "\\N", compression: str = "none") -> None:
    """SELECT INTO OUTFILE: text files in a folder."""
    df.write.mode("errorifexists").options(sep=delimiter, quote=enclosed, nullValue=null, emptyValue="", compression=compression, escape="\\").csv(path)


_CODES = {T.ByteType: "b", T.ShortType: "h", T.IntegerType: "i", T.LongType: "q", T.FloatType: "f", T.DoubleType: "d"}


def load_binary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fixed-width little-endian rows of numbers and char(n); the type's smallest integer (for floats, NaN) is NULL."""
    want = T.StructType.fromDDL(schema)
    kinds = [f.dataType for f in want.fields]
    codes = [_CODES.get(type(k)) or f"{k.simpleString()[5:-1]}s" for k in kinds]
    layout = "<" + "".join(codes)
    width = struct.calcsize(layout)
    lowest = [-(1 << (8 * struct.calcsize(c) - 1)) if c in "bhiq" else None for c in codes]
    names = [f.name for f in want.fields]

    def run(batches):
        for frame in batches:
            for content in frame["content"]:
                for begin in range(0, len(content), width * 65_536):
                    rows = [tuple(None if v == low or v != v else v.rstrip(b"\0 ").decode() if isinstance(v, bytes) else v for v, low in zip(row, lowest, strict=True)) for row in struct.iter_unpack(layout, content[begin : begin + width * 65_536])]
                    yield pd.DataFrame(rows, columns=names, dtype=object)

    out = ", ".join(f"`{f.name}` {'string' if c[-1] == 's' else f.dataType.simpleString()}" for f, c in zip(want.fields, codes, strict=True))
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, out)


def load_parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet files, cast to ``schema`` by column order if one is given; nested columns are refused."""
    df = spark.read.parquet(path)
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    if nested:
        raise LoadError(f"nested columns are not supported: {', '.join(nested)}")
    if schema is None:
        return df
    want = T.StructType.fromDDL(schema)
    return df.select(*[F.col(f"`{c}`").cast(f.dataType).alias(f.name) for c, f in zip(df.columns, want.fields, strict=True)])


def ddl_of_parquet(spark: SparkSession, path: str, table: str) -> str:
    """CREATE TABLE text for a Parquet file."""
    kinds = {"string": "VARCHAR(2000)", "timestamp_ntz": "DATETIME", "int": "INT", "binary": "BLOB"}
    body = ", ".join(f"{f.name} {kinds.get(f.dataType.simpleString(), f.dataType.simpleString().upper())}" for f in load_parquet(spark, path).schema.fields)
    return f"CREATE TABLE {table} ({body})"


def cross_engine(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Rows of a query on another engine over JDBC; filters and columns are pushed to it."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


DERBY = "org.apache.derby.jdbc.EmbeddedDriver"
_DERBY_KINDS = {T.ByteType: "SMALLINT", T.ShortType: "SMALLINT", T.IntegerType: "INTEGER", T.LongType: "BIGINT", T.FloatType: "DOUBLE", T.DoubleType: "DOUBLE", T.StringType: "VARCHAR(32672)"}


def derby_archive(df: DataFrame, table: str) -> str:
    """The JDBC URL of a new Derby database that holds ``df`` as ``table``; column names keep their case.

    An embedded database belongs to the process that opened it, so what one executor writes no other sees.
    Here tasks write the rows as text, the driver's Derby loads them on disk and closes the database, and
    its archive in the shared folder can be read by any number of processes.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if urlsplit(folder).scheme != "file":
        raise LoadError(f"Derby reads mounted folders only, not {folder}")
    at, jvm, local = urlsplit(folder).path, spark.sparkContext._jvm, tempfile.mkdtemp(prefix="larkspur-")
    df.write.csv(f"{folder}/rows", escape='"')  # NULL is nothing, an empty text a pair of quotes, as Derby has it
    try:
        jvm.java.lang.Class.forName(DERBY)
        connection = jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:{local}/data;create=true")
        try:
            run = connection.createStatement()
            columns = ['"%s" %s' % (f.name, _DERBY_KINDS[type(f.dataType)]) for f in df.schema.fields]
            run.execute(f"create table {table} ({', '.join(columns)})")
            for path in sorted(glob.glob(f"{glob.escape(at)}/rows/part-*.csv")):
                quoted = path.replace("'", "''")
                run.execute(f"call syscs_util.syscs_import_table(null, '{table.upper()}', '{quoted}', ',', '\"', 'UTF-8', 0)")
        finally:
            connection.close()
            try:
                jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:{local}/data;shutdown=true")
            except Py4JJavaError as e:
                if e.java_exception.getSQLState() != "08006":  # this says that it is closed
                    raise
        with zipfile.ZipFile(f"{at}/data.jar", "w", zipfile.ZIP_STORED) as z:
            for place, _, names in os.walk(f"{local}/data"):
                for name in names:
                    path = os.path.join(place, name)
                    z.write(path, os.path.relpath(path, local))
    finally:
        shutil.rmtree(local, ignore_errors=True)
        discard_folder(spark, f"{folder}/rows")
    return f"jdbc:derby:jar:({at}/data.jar)data"
