"""Numeric, bit and hash functions. Arguments are Columns or column names."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType

from larkspur.functions.text import Col, _text, col

_FULL = "18446744073709551616"


def divide(a: Col, b: Col) -> Column:
    """NULL for a zero divisor."""
    return F.when(col(b) != 0, col(a) / col(b))


def div(a: Col, b: Col) -> Column:
    """Integer division, truncated; NULL for a zero divisor."""
    q = F.when(col(b) != 0, col(a).cast("double") / col(b).cast("double"))
    return F.when(q >= 0, F.floor(q)).otherwise(F.ceil(q)).cast("long")


def mod(a: Col, b: Col) -> Column:
    return F.when(col(b) != 0, F.try_mod(col(a), col(b)))


def absolute(x: Col) -> Column:
    return F.abs(col(x))


def sign(x: Col) -> Column:
    return F.signum(col(x)).cast("bigint")


def conv(n: Col, source: int, target: int) -> Column:
    if not (2 <= abs(source) <= 36 and 2 <= abs(target) <= 36):
        return F.lit(None).cast("string")
    return F.conv(_text(n), source, target)


def crc32(s: Col, seed: int | None = None) -> Column:
    """Unsigned; with a seed the running form, which no built-in has."""
    if not seed:
        return F.crc32(F.encode(_text(s), "UTF-8"))

    @F.pandas_udf(LongType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else zlib.crc32(t.encode(), seed))

    return run(_text(s))


def _finite(x: Column, name: str) -> Column:
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(f"{name} value is out of range")).cast("double")).otherwise(x)


def exp(x: Col) -> Column:
    """Overflow is an error, underflow 0."""
    return _finite(F.exp(col(x)), "EXP")


def power(x: Col, y: Col | int | float) -> Column:
    e = F.lit(y) if isinstance(y, (int, float)) else col(y)
    return _finite(F.pow(col(x), e), "POW")


def rand(seed: int | None = None) -> Column:
    return F.rand(seed)


def acos(x: Col) -> Column:
    return F.when(F.abs(col(x)) <= 1, F.acos(col(x)))


def asin(x: Col) -> Column:
    return F.when(F.abs(col(x)) <= 1, F.asin(col(x)))


def atan(x: Col, y: Col | None = None) -> Column:
    return F.atan(col(x)) if y is None else F.atan2(col(x), col(y))


def cot(x: Col) -> Column:
    return F.when(F.tan(col(x)) != 0, F.cot(col(x)))


def sqrt(x: Col) -> Column:
    return F.when(col(x) >= 0, F.sqrt(col(x)))


def ln(x: Col) -> Column:
    return F.when(col(x) > 0, F.ln(col(x)))


def log(x: Col, base: float | None = None) -> Column:
    if base is None:
        return ln(x)
    if base <= 0 or base == 1:
        return F.lit(None).cast("double")
    return F.when(col(x) > 0, F.log(float(base), col(x)))


def log2(x: Col) -> Column:
    return F.when(col(x) > 0, F.log2(col(x)))


def log10(x: Col) -> Column:
    return F.when(col(x) > 0, F.log10(col(x)))


def round_half_up(x: Col, digits: int = 0) -> Column:
    return F.round(col(x), digits)


def truncate(x: Col, digits: int = 0) -> Column:
    """Towards zero at ``digits`` places (negative: before the point)."""
    scale = F.lit(10.0) ** abs(digits)
    moved = col(x) * scale if digits >= 0 else col(x) / scale
    cut = F.when(moved >= 0, F.floor(moved)).otherwise(F.ceil(moved))
    return (cut / scale if digits >= 0 else cut * scale).cast("double")


def format_number(x: Col, digits: int) -> Column:
    return F.format_number(col(x), max(0, digits))


def unsigned(x: Column) -> Column:
    """A 64-bit pattern as an unsigned decimal."""
    return F.when(x < 0, x.cast("decimal(20,0)") + F.lit(_FULL).cast("decimal(20,0)")).otherwise(x.cast("decimal(20,0)")).cast("decimal(20,0)")


def bit_count(x: Col) -> Column:
    return F.bit_count(col(x).cast("bigint"))


def bit_and(a: Col, b: Col) -> Column:
    return unsigned(col(a).cast("bigint").bitwiseAND(col(b).cast("bigint")))


def bit_or(a: Col, b: Col) -> Column:
    return unsigned(col(a).cast("bigint").bitwiseOR(col(b).cast("bigint")))


def bit_xor(a: Col, b: Col) -> Column:
    return unsigned(col(a).cast("bigint").bitwiseXOR(col(b).cast("bigint")))


def bit_not(a: Col) -> Column:
    return unsigned(F.bitwise_not(col(a).cast("bigint")))


def shift_left(a: Col, n: int) -> Column:
    return unsigned(F.shiftleft(col(a).cast("bigint"), n) if 0 <= n < 64 else F.lit(0).cast("bigint"))


def shift_right(a: Col, n: int) -> Column:
    return unsigned(F.shiftrightunsigned(col(a).cast("bigint"), n) if 0 <= n < 64 else F.lit(0).cast("bigint"))


def binary(n: Col) -> Column:
    return F.bin(col(n).cast("bigint"))


def leading_number(s: Col) -> Column:
    """The number a string begins with; 0 where it begins with none."""
    found = F.regexp_extract(_text(s), r"\A\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.when(_text(s).isNotNull(), F.coalesce(found.try_cast("double"), F.lit(0.0)))


def convert(x: Col, kind: str) -> Column:
    """CAST that never raises; text to a number takes its leading digits."""
    kind = kind.lower()
    if kind in ("signed", "integer", "unsigned"):
        n = F.round(leading_number(_text(x))).try_cast("bigint")
        return unsigned(n) if kind == "unsigned" else n
    if kind == "double":
        return leading_number(_text(x))
    if kind.startswith("decimal"):
        return leading_number(_text(x)).try_cast(kind)
    if kind.startswith("char"):
        n = kind[5:-1] if "(" in kind else ""
        return F.left(_text(x), F.lit(int(n))) if n else _text(x)
    return col(x).try_cast(kind)


def md5(s: Col) -> Column:
    return F.md5(_text(s).cast("binary"))


def sha1(s: Col) -> Column:
    return F.sha1(_text(s).cast("binary"))


def sha2(s: Col, bits: int) -> Column:
    return F.sha2(_text(s).cast("binary"), bits) if bits in (0, 224, 256, 384, 512) else F.lit(None).cast("string")


def compress(s: Col) -> Column:
    """zlib data after a 4-byte little-endian length; empty stays empty."""

    @F.pandas_udf(BinaryType())
    def run(texts: pd.Series) -> pd.Series:
        def pack(t: str | None) -> bytes | None:
            raw = None if t is None else t.encode()
            return raw and len(raw).to_bytes(4, "little") + zlib.compress(raw)

        return texts.map(pack)

    return run(_text(s))


def uncompress(data: Col) -> Column:
    """NULL for anything that ``compress`` did not make."""

    @F.pandas_udf(StringType())
    def run(items: pd.Series) -> pd.Series:
        def unpack(b: bytes | None) -> str | None:
            try:
                return None if b is None else zlib.decompress(bytes(b)[4:]).decode() if len(b) else ""
            except (zlib.error, UnicodeDecodeError):
                return None

        return items.map(unpack)

    return run(col(data).cast("binary"))


def uncompressed_length(data: Col) -> Column:
    b = F.hex(col(data).cast("binary"))
    byte = lambda k: F.substring(b, 2 * k + 1, 2)
    return F.when(b == "", 0).otherwise(F.conv(F.concat(*[byte(k) for k in (3, 2, 1, 0)]), 16, 10).cast("bigint")).cast("bigint")


