"""Operator 7: line dedup by site-relative frequency, in DataFrame functions only.

Pages are grouped by host; a line is boilerplate of a host when the pages that contain it, divided
by the host's pages, exceed a ratio. Boilerplate lines are dropped from every page of that host.

Lines are compared by a 128-bit key of host and line (two xxhash64 of different seeds), so what is
shuffled is two longs a line and map-side sums collapse the hot lines and hosts first. A page with
L lines can hold at most L lines above the ratio r, so a host has at most (mean lines a page) / r
boilerplate lines whatever its page count; they travel as one table for each host, an array of small
hash buckets, and the pages' texts are never exploded back together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import cut, free, quoted

#: A line that only one page has is no duplicate, so two pages are the least; the ratio decides all else.
RATIO, MIN_PAGES = 0.1, 2
_BUCKET = 4
_TAG = "\u0001"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _blank(line: Column) -> Column:
    return ~line.rlike(r"[^\x20\x09-\x0D]")


def _key(host: Column, line: Column) -> Column:
    """Null and empty hosts differ: the second part tells them apart."""
    return F.struct(F.xxhash64(host, line).alias("a"), F.xxhash64(line, F.lit(_TAG), host, host.isNull()).alias("b"))


def boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row for each host that has boilerplate: host, keys (its line keys in arrays by the key modulo their number, about ``_BUCKET`` in each)."""
    rows = pages.select(F.col(quoted(host_col)).alias("host"), F.col(quoted(text_col)).alias("text"))
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    keys = rows.select("host", F.explode(F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: ~_blank(x)), lambda x: _key(F.col("host"), x)))).alias("key"))
    counts = keys.groupBy("key", "host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    over = counts.join(totals, counts["host"].eqNullSafe(totals["host"])).where(F.col("n") > F.lit(ratio) * F.col("pages"))
    over = over.select(counts["host"].alias("host"), "key")
    sized = over.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / _BUCKET).cast("int").alias("n")).select("host", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
    slots = over.join(sized.where("at = 0").select(F.col("host").alias("h"), "n"), F.col("host").eqNullSafe(F.col("h"))).groupBy("host", _slot(F.col("key"), F.col("n")).alias("at")).agg(F.collect_list("key").alias("keys"))
    filled = slots.select("host", "at", "keys").unionByName(sized.select("host", "at", F.array().cast(slots.schema["keys"].dataType).alias("keys")))
    one = filled.groupBy("host", "at").agg(F.flatten(F.collect_list("keys")).alias("keys"))
    return one.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "keys"))), lambda x: x["keys"]).alias("keys"))


def _slot(key: Column, n: Column) -> Column:
    return F.pmod(key["a"], n).cast("int")


def _known(keys: Column, key: Column) -> Column:
    return F.array_contains(F.get(keys, _slot(key, F.size(keys))), key)


def drop_boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: bool = False) -> DataFrame:
    """``pages`` with boilerplate lines taken out of ``text_col``; all other columns stay.

    A line is what stands between ``\\n``; lines without a word are neither counted nor dropped. A
    line is dropped when more than ``ratio`` of its host's pages and at least ``min_pages`` pages
    contain it (repeats within a page count once); with ``min_pages`` 1 the ratio alone decides, and
    small hosts lose every line. ``counts`` adds n_lines and n_dropped (lines with
    a word). A text all of whose lines go becomes empty; a null text stays null (0 lines); rows of a
    null host form one host; repeated rows count as pages of their own; an empty table stays empty.

    The per-host tables are written first, so the join with the pages broadcasts them exactly when
    their measured size allows it, and else sorts and splits hot hosts (adaptive skew join).
    """
    h, k, t, n = free(pages, "_host", "_keys", "_text", "_n")
    table = cut(boilerplate(pages, host_col, text_col, ratio, min_pages)).select(F.col("host").alias(h), F.col("keys").alias(k))
    host, text = F.col(quoted(host_col)), F.col(quoted(text_col))
    joined = pages.join(table, host.eqNullSafe(F.col(h)), "left")
    good = F.filter(_lines(text), lambda x: _blank(x) | ~_known(F.col(k), _key(host, x)))
    kept = F.when(F.col(k).isNull(), text).otherwise(F.array_join(good, "\n"))
    worded = lambda x: F.when(x.isNull(), 0).otherwise(F.size(F.filter(_lines(x), lambda y: ~_blank(y)))).cast("long")
    out = joined.select(*[F.col(quoted(c)) for c in pages.columns], kept.alias(t), *([worded(text).alias(n)] if counts else []))
    columns = [F.col(t).alias(c) if c == text_col else F.col(quoted(c)) for c in pages.columns if not (counts and c.lower() in ("n_lines", "n_dropped"))]
    if counts:
        columns += [F.col(n).alias("n_lines"), (F.col(n) - worded(F.col(t))).alias("n_dropped")]
    return out.select(*columns)
