"""String functions. Arguments are Columns or column names; positions count from 1."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

Col = Column | str


def col(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _int(x: Col | int) -> Column:
    return F.lit(x) if isinstance(x, int) else col(x)


def _text(x: Col) -> Column:
    return col(x).cast("string")


def _word(x: Col) -> Column:
    """A plain Python string is a literal here, unlike in ``col``."""
    return F.lit(x) if isinstance(x, str) else x


def ascii_code(s: Col) -> Column:
    """Value of the first byte; 0 for an empty string."""
    first = F.conv(F.substring(F.hex(F.encode(_text(s), "UTF-8")), 1, 2), 16, 10).cast("int")
    return F.when(_text(s) == "", 0).otherwise(first)


def char_of(*codes: Col | int) -> Column:
    """Bytes of each integer, highest first, as text; NULL arguments are skipped."""

    def part(n: Column) -> Column:
        digits = F.hex(n.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
        return F.coalesce(F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits), F.lit(""))

    return F.decode(F.unhex(F.concat(*[part(_int(n)) for n in codes])), "UTF-8")


def char_length(s: Col) -> Column:
    return F.char_length(_text(s))


def byte_length(s: Col) -> Column:
    return F.octet_length(_text(s))


def concat(*parts: Col) -> Column:
    return F.concat(*[_text(p) for p in parts])


def concat_oracle(*parts: Col) -> Column:
    """NULL arguments are skipped; NULL when all are."""
    texts = [_text(p) for p in parts]
    return F.when(F.coalesce(*texts).isNotNull(), F.concat_ws("", *texts))


def concat_ws(sep: Column | str, *parts: Col) -> Column:
    """``sep`` may be a column; NULL then gives NULL. NULL parts are skipped."""
    if isinstance(sep, str):
        return F.concat_ws(sep, *[_text(p) for p in parts])
    items = F.array_compact(F.array(*[_text(p) for p in parts]))
    joined = F.aggregate(F.slice(items, F.lit(2), F.greatest(F.size(items), F.lit(1))), F.coalesce(F.get(items, F.lit(0)), F.lit("")), lambda a, x: F.concat(a, sep, x))
    return F.when(sep.isNotNull(), F.when(F.size(items) == 0, "").otherwise(joined))


def elt(n: Col | int, *items: Col) -> Column:
    return F.when(_int(n).between(1, len(items)), F.try_element_at(F.array(*[_text(i) for i in items]), F.greatest(_int(n).cast("int"), F.lit(1))))


def find_in_set(s: Col, items: Col) -> Column:
    return F.find_in_set(_text(s), _text(items))


_FORMATS = {
    "DATE": {"USA": "%m.%d.%Y", "JIS": "%Y-%m-%d", "ISO": "%Y-%m-%d", "EUR": "%d.%m.%Y", "INTERNAL": "%Y%m%d"},
    "TIME": {"USA": "%h:%i:%s %p", "JIS": "%H:%i:%s", "ISO": "%H:%i:%s", "EUR": "%H.%i.%s", "INTERNAL": "%H%i%s"},
    "DATETIME": {"USA": "%Y-%m-%d %H.%i.%s", "JIS": "%Y-%m-%d %H:%i:%s", "ISO": "%Y-%m-%d %H:%i:%s", "EUR": "%Y-%m-%d %H.%i.%s", "INTERNAL": "%Y%m%d%H%i%s"},
}


def get_format(kind: str, region: str) -> Column:
    return F.lit(_FORMATS.get(kind.upper(), {}).get(region.upper(), ""))


def hex_of(x: Col, numeric: bool = False) -> Column:
    """Numbers are rounded to an integer first; everything else is the hex of its text's bytes."""
    return F.hex(F.round(col(x)).cast("long")) if numeric else F.hex(F.encode(_text(x), "UTF-8"))


def unhex(s: Col) -> Column:
    """An odd first digit is a byte of its own; a bad digit gives NULL."""
    t = _text(s)
    padded = F.when(F.length(t) % 2 == 1, F.concat(F.lit("0"), t)).otherwise(t)
    return F.decode(F.when(t.rlike(r"\A[0-9A-Fa-f]*\z"), F.unhex(padded)), "UTF-8")


def inet_aton(s: Col) -> Column:
    """Dotted address to integer; short forms fill from the right as in 127.1; bad input gives NULL."""
    t = _text(s)
    p = F.split(t, r"\.")
    n = F.size(p)
    part = lambda i: F.get(p, i).try_cast("bigint")
    last = part(n - 1)
    head = sum((F.when(n > k + 1, part(F.lit(k)) * (256 ** (3 - k))).otherwise(0) for k in range(3)), F.lit(0).cast("bigint"))
    fine = t.rlike(r"\A\d{1,3}(\.\d{1,3}){0,3}\z") & F.forall(p, lambda x: F.coalesce(x.try_cast("int") <= 255, F.lit(False)))
    return F.when(fine, head + last)


def inet_ntoa(n: Col) -> Column:
    v = col(n).cast("bigint")
    return F.when(v.between(0, 4294967295), F.concat_ws(".", *[F.shiftright(v, k).bitwiseAND(F.lit(255)).cast("string") for k in (24, 16, 8, 0)]))


def insert(s: Col, pos: Col | int, length: Col | int, new: Col) -> Column:
    t, p, n = _text(s), _int(pos), _int(length)
    rest = F.when((n < 0) | (p + n > F.char_length(t)), F.lit("")).otherwise(F.substring(t, p + n, F.char_length(t)))
    made = F.concat(F.substring(t, F.lit(1), p - 1), _text(new), rest)
    return F.when(t.isNull() | col(new).isNull() | p.isNull() | n.isNull(), None).when((p < 1) | (p > F.char_length(t)), t).otherwise(made)


def instr(s: Col, sub: Col, start: Col | int = 1) -> Column:
    """Place of ``sub`` in ``s`` from ``start`` on; 0 if absent; an empty ``sub`` is found at ``start``."""
    t, x, p = _text(s), _text(sub), _int(start)
    at = F.call_function("locate", x, t, p)
    return F.when(p < 1, 0).when((x == "") & (p <= F.char_length(t) + 1), p).otherwise(at)


def lower(s: Col) -> Column:
    return F.lower(_text(s))


def upper(s: Col) -> Column:
    return F.upper(_text(s))


def left(s: Col, n: Col | int) -> Column:
    return F.when(_int(n) <= 0, F.when(_text(s).isNotNull(), "")).otherwise(F.left(_text(s), _int(n)))


def right(s: Col, n: Col | int) -> Column:
    return F.when(_int(n) <= 0, F.when(_text(s).isNotNull(), "")).otherwise(F.right(_text(s), _int(n)))


def _pad(function: str, s: Col, n: Col | int, pad: Column | str) -> Column:
    t, fill = _text(s), _word(pad)
    made = F.call_function(function, t, _int(n), fill)
    return F.when(_int(n) < 0, None).when((t == "") | (fill == ""), F.substring(t, F.lit(1), _int(n))).otherwise(made)


def lpad(s: Col, n: Col | int, pad: Column | str = " ") -> Column:
    """Empty ``s`` stays empty; a shorter ``n`` truncates."""
    return _pad("lpad", s, n, pad)


def rpad(s: Col, n: Col | int, pad: Column | str = " ") -> Column:
    return _pad("rpad", s, n, pad)


def trim(s: Col, what: str = " ", leading: bool = True, trailing: bool = True) -> Column:
    """``what`` is a whole string taken off either end as often as it occurs, not a set of characters."""
    t, x = _text(s), re.escape(what)
    if what and leading:
        t = F.regexp_replace(t, rf"\A(?:{x})+", "")
    if what and trailing:
        t = F.regexp_replace(t, rf"(?:{x})+\z", "")
    return t


def ltrim(s: Col, what: str = " ") -> Column:
    return trim(s, what, trailing=False)


def rtrim(s: Col, what: str = " ") -> Column:
    return trim(s, what, leading=False)


def null_if_empty(s: Column) -> Column:
    """Oracle mode: an empty result is NULL."""
    return F.when(s != "", s)


def trim_oracle(s: Col, what: str = " ") -> Column:
    return null_if_empty(trim(s, what))


def ltrim_oracle(s: Col, what: str = " ") -> Column:
    return null_if_empty(ltrim(s, what))


def rtrim_oracle(s: Col, what: str = " ") -> Column:
    return null_if_empty(rtrim(s, what))


def quote(s: Col) -> Column:
    t = _text(s)
    for plain, code in (("\\", "\\\\"), ("'", "\\'"), ("\0", "\\0"), ("\x1a", "\\Z")):
        t = F.replace(t, F.lit(plain), F.lit(code))
    return F.coalesce(F.concat(F.lit("'"), t, F.lit("'")), F.lit("NULL"))


def repeat(s: Col, n: Col | int) -> Column:
    """NULL for n < 1."""
    return F.when(_int(n) >= 1, F.repeat(_text(s), _int(n)))


def replace(s: Col, old: Col, new: Col) -> Column:
    return F.when(_text(old) == "", _text(s)).otherwise(F.replace(_text(s), _text(old), _text(new)))


def replace_oracle(s: Col, old: Col, new: Col) -> Column:
    o = F.coalesce(_text(old), F.lit(""))
    made = F.when(o == "", _text(s)).otherwise(F.replace(_text(s), o, F.coalesce(_text(new), F.lit(""))))
    return null_if_empty(made)


def reverse(s: Col) -> Column:
    return F.reverse(_text(s))


def space(n: Col | int) -> Column:
    return F.when(_int(n) >= 1, F.repeat(F.lit(" "), _int(n)))


def strcmp(a: Col, b: Col, ignore_case: bool = False) -> Column:
    """-1, 0 or 1; trailing blanks do not count."""
    x, y = F.rtrim(_text(a)), F.rtrim(_text(b))
    if ignore_case:
        x, y = F.lower(x), F.lower(y)
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def substr(s: Col, pos: Col | int, length: Col | int | None = None) -> Column:
    """Position 0 or outside gives an empty string; a negative one counts from the end."""
    t, p = _text(s), _int(pos)
    size = F.char_length(t)
    start = F.when(p < 0, size + p + 1).otherwise(p)
    n = size if length is None else _int(length)
    made = F.substring(t, start, n)
    return F.when(t.isNull() | p.isNull() | n.isNull(), None).when((start < 1) | (n < 1), "").otherwise(made)


def substring_index(s: Col, delimiter: str, n: int) -> Column:
    return F.substring_index(_text(s), delimiter, n) if delimiter and n else F.when(_text(s).isNotNull(), "")


class _Shuffle:
    """The key-dependent byte permutation and running mask of the legacy ENCODE and DECODE."""

    _TOP = 0x3FFFFFFF

    def __init__(self, key: bytes):
        one, two, extra = 1345345333, 0x12345671, 7
        for byte in key:
            if byte not in b" \t":
                one = (one ^ ((((one & 63) + extra) * byte) + (one << 8))) & 0xFFFFFFFFFFFFFFFF
                two = (two + ((two << 8) ^ one)) & 0xFFFFFFFFFFFFFFFF
                extra += byte
        self.one, self.two = (one & 0x7FFFFFFF) % self._TOP, (two & 0x7FFFFFFF) % self._TOP
        self.back = list(range(256))
        for i in range(256):
            j = self.draw()
            self.back[i], self.back[j] = self.back[j], self.back[i]
        self.forth = [0] * 256
        for i, x in enumerate(self.back):
            self.forth[x] = i
        self.mask = 0

    def draw(self) -> int:
        self.one = (self.one * 3 + self.two) % self._TOP
        self.two = (self.one + self.two + 33) % self._TOP
        return int(self.one / self._TOP * 255.0)

    def encode(self, data: bytes) -> bytes:
        out = bytearray()
        for x in data:
            self.mask ^= self.draw()
            out.append((self.forth[x] ^ self.mask) & 255)
            self.mask ^= x
        return bytes(out)

    def decode(self, data: bytes) -> bytes:
        out = bytearray()
        for x in data:
            self.mask ^= self.draw()
            plain = self.back[(x ^ self.mask) & 255]
            out.append(plain)
            self.mask ^= plain
        return bytes(out)


class _Batches:
    """``_Shuffle`` over whole Arrow arrays: the key is set up once, and as its draws don't depend on the data, every text starts from the same ones."""

    def __init__(self, key: bytes):
        self.shuffle = _Shuffle(key)
        self.back, self.forth = (np.array(x, np.uint8) for x in (self.shuffle.back, self.shuffle.forth))
        self.draws = np.zeros(0, np.uint8)

    def drawn(self, n: int) -> np.ndarray:
        """All draws before and at each of the first ``n`` positions, combined."""
        if (have := len(self.draws)) < n:
            more = np.array([self.shuffle.draw() for _ in range(max(n, 2 * have) - have)], np.uint8)
            if have:
                more[0] ^= self.draws[-1]
            self.draws = np.concatenate([self.draws, np.bitwise_xor.accumulate(more)])
        return self.draws[:n]

    @staticmethod
    def parts(items: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all items, and where each begins."""
        items = items.cast(pa.large_binary())
        _, offsets, data = items.buffers()
        at = np.frombuffer(offsets, np.int64, len(items) + 1, items.offset * 8)
        return np.frombuffer(data, np.uint8, at[-1])[at[0] :] if at[-1] > at[0] else np.zeros(0, np.uint8), at - at[0]

    @staticmethod
    def whole(like: pa.Array, data: np.ndarray, at: np.ndarray) -> pa.Array:
        known = pa.array(like.is_valid().to_numpy(zero_copy_only=False)).buffers()[1] if like.null_count else None
        return pa.Array.from_buffers(pa.large_binary(), len(like), [known, pa.py_buffer(at), pa.py_buffer(data)]).cast(pa.binary())

    def encode(self, items: pa.Array) -> pa.Array:
        data, at = self.parts(items)
        sizes = np.diff(at)
        begins = np.repeat(at[:-1], sizes)
        before = np.concatenate([np.zeros(1, np.uint8), np.bitwise_xor.accumulate(data)])[:-1] if len(data) else data
        return self.whole(items, self.forth[data] ^ self.drawn(sizes.max(initial=0))[np.arange(len(data)) - begins] ^ before ^ before[begins], at)

    def decode(self, items: pa.Array) -> pa.Array:
        """Position by position over all items that are so long; the last few, of very long ones, byte by byte."""
        data, at = self.parts(items)
        sizes = np.diff(at)
        order = np.argsort(-sizes, kind="stable")
        begins, sizes = at[:-1][order], sizes[order]
        longest, out, mask = int(sizes.max(initial=0)), np.zeros(len(data), np.uint8), np.zeros(len(sizes), np.uint8)
        drawn = self.drawn(longest)
        left = len(sizes) - np.cumsum(np.bincount(sizes, minlength=longest + 1))  # items longer than each position
        for i in range(longest):
            n = int(left[i])
            if n < 16:
                self._rest(data, out, begins[:n], sizes[:n], mask, drawn, i)
                break
            here = begins[:n] + i
            plain = self.back[data[here] ^ drawn[i] ^ mask[:n]]
            out[here] = plain
            mask[:n] ^= plain
        return self.whole(items, out, at)

    def _rest(self, data: np.ndarray, out: np.ndarray, begins: np.ndarray, sizes: np.ndarray, masks: np.ndarray, drawn: np.ndarray, i: int) -> None:
        back = self.back.tobytes()
        for begin, size, mask in zip(begins.tolist(), sizes.tolist(), masks.tolist(), strict=False):
            plain = bytearray()
            for x in (data[begin + i : begin + size] ^ drawn[i:size]).tobytes():
                plain.append(p := back[x ^ mask])
                mask ^= p
            out[begin + i : begin + size] = np.frombuffer(plain, np.uint8)


@lru_cache(8)
def _batches(key: bytes) -> _Batches:
    return _Batches(key)


def encode(s: Col, password: str) -> Column:
    """Legacy encryption to bytes; a Python function over Arrow arrays, since no built-in has it."""
    key = password.encode()

    @F.arrow_udf(BinaryType())
    def run(texts: pa.Array) -> pa.Array:
        return _batches(key).encode(texts)

    return run(_text(s))


def decode(data: Col, password: str) -> Column:
    key = password.encode()

    @F.arrow_udf(StringType())
    def run(items: pa.Array) -> pa.Array:
        plain = _batches(key).decode(items)
        try:
            return plain.cast(pa.string())
        except pa.ArrowInvalid:  # another password's, or damaged
            return pa.array([None if b is None else b.decode("utf-8", "replace") for b in plain.to_pylist()], pa.string())

    return run(col(data).cast("binary"))


def like(s: Col, pattern: str, escape: str = "\\") -> Column:
    return F.like(_text(s), F.lit(pattern), F.lit(escape))


def regexp_like(s: Col, pattern: str, ignore_case: bool = False) -> Column:
    return _text(s).rlike(("(?i)" if ignore_case else "") + pattern)


def regexp_instr(s: Col, pattern: str) -> Column:
    return F.regexp_instr(_text(s), F.lit(pattern))


def regexp_replace(s: Col, pattern: str, new: str) -> Column:
    """Back-references are written ``\\1``."""
    return F.regexp_replace(_text(s), pattern, re.sub(r"\\(\d)", r"$\1", new))


def regexp_substr(s: Col, pattern: str) -> Column:
    """The first match; an empty string where nothing matches."""
    return F.when(_text(s).isNotNull(), F.coalesce(F.regexp_substr(_text(s), F.lit(pattern)), F.lit("")))
