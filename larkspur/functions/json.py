"""JSON functions over text. What built-ins express stays in the JVM; path edits, searches and merges
are Arrow-batched Python functions over one parsed document a row. Invalid JSON gives NULL.

Paths: ``$``, ``.key``, ``."key"``, ``.*``, ``[n]``, ``[-n]``, ``[last]``, ``[last-n]``, ``[a to b]``, ``[*]``, ``**``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StringType

from larkspur.functions.text import Col, _text, col

_STEP = re.compile(r'\s*(?:\.\s*(?:"((?:[^"\\]|\\.)*)"|(\*)|([^\s.\[\]*"]+))|\[\s*(?:(\*)|(-?\d+|last(?:\s*-\s*\d+)?)(?:\s+to\s+(-?\d+|last(?:\s*-\s*\d+)?))?)\s*\]|(\*\*))')


class _MISSING:
    """Stands for a document that is NULL or no JSON; a class, so that workers see the same one."""




def parse_path(path: str) -> list[tuple]:
    """Steps: ("key", name), ("any",), ("at", from, to), ("each",), ("deep",). Raises ValueError on bad syntax."""
    text = path.strip()
    if not text.startswith("$"):
        raise ValueError(f"not a JSON path: {path}")
    steps, i = [], 1
    while i < len(text):
        m = _STEP.match(text, i)
        if not m:
            raise ValueError(f"not a JSON path: {path}")
        quoted, star, name, each, low, high, deep = m.groups()
        if quoted is not None or name is not None:
            steps.append(("key", json.loads(f'"{quoted}"') if quoted is not None else name))
        elif star:
            steps.append(("any",))
        elif each:
            steps.append(("each",))
        elif deep:
            steps.append(("deep",))
        else:
            steps.append(("at", low, high))
        i = m.end()
    return steps


def _index(mark: str, n: int) -> int:
    if mark.startswith("last"):
        return n - 1 - int(re.sub(r"\D", "", mark) or 0)
    return int(mark) + (n if mark.startswith("-") else 0)


def _walk(value: Any, steps: list[tuple], at: tuple = ()) -> list[tuple[tuple, Any]]:
    """(keys, value) of everything a path matches."""
    if not steps:
        return [(at, value)]
    (kind, *rest), tail = steps[0], steps[1:]
    found: list[tuple[tuple, Any]] = []
    if kind == "key" and isinstance(value, dict) and rest[0] in value:
        found = _walk(value[rest[0]], tail, (*at, rest[0]))
    elif kind == "any" and isinstance(value, dict):
        for k, v in value.items():
            found += _walk(v, tail, (*at, k))
    elif kind == "each" and isinstance(value, list):
        for k, v in enumerate(value):
            found += _walk(v, tail, (*at, k))
    elif kind == "at":
        items = value if isinstance(value, list) else [value]
        low = _index(rest[0], len(items))
        for k in range(max(0, low), min(len(items) - 1, _index(rest[1], len(items)) if rest[1] else low) + 1) if low >= 0 or rest[1] else ():
            found += _walk(items[k], tail, (*at, k) if isinstance(value, list) else at)
    elif kind == "deep":
        found = _walk(value, tail, at)
        children = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
        for k, v in children:
            found += _walk(v, steps, (*at, k))
    return found


def _refuse(name: str) -> None:
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_constant=_refuse)


def _load(text: str | None) -> Any:
    if text is None:
        return _MISSING
    try:
        return _DECODER.decode(text)
    except (ValueError, RecursionError):
        return _MISSING


def _loose(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(", ", ": "))


def _tight(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _apply(kind: DataType, function: Callable[..., Any], *columns: Column) -> Column:
    """Row by row over Arrow batches; the function gets Python values and may return None."""

    made = pa.string() if isinstance(kind, StringType) else pa.int64()

    @F.arrow_udf(kind)
    def run(*columns: pa.Array) -> pa.Array:
        return pa.array(map(function, *(c.to_pylist() for c in columns)), made)

    return run(*columns)


#: Documents parsed last, for functions that only read: those of one row set look at the same texts. About ``_KEPT`` characters are kept.
_PARSED: dict[str | None, Any] = {}
_KEPT, _held = 1 << 23, [0]


def _parsed(text: str | None) -> Any:
    found = _PARSED.get(text, _PARSED)
    if found is _PARSED:
        _held[0] += 100 + len(text or "")
        if _held[0] > _KEPT:
            _PARSED.clear()
            _held[0] = 0
        found = _PARSED[text] = _load(text)
    return found


def _on_document(kind: DataType, function: Callable[..., Any], doc: Col, *others: Column, reads: bool = True) -> Column:
    """``function`` of the parsed document; one that changes it says so with ``reads``."""
    load = _parsed if reads else _load

    def run(text: str | None, *rest: Any) -> Any:
        value = load(text)
        return None if value is _MISSING else function(value, *rest)

    return _apply(kind, run, _text(doc), *others)


def _value(x: Column | object) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def json_valid(j: Col) -> Column:
    return F.when(_text(j).isNotNull(), F.coalesce(_on_document(LongType(), lambda v: 1, j), F.lit(0)))


def json_array(*items: Col) -> Column:
    """Numbers and booleans as such, text quoted, NULL as null."""
    return F.concat(F.lit("["), *_joined([_literal(col(i)) for i in items]), F.lit("]"))


def json_object(*pairs: tuple[str, Col]) -> Column:
    return F.concat(F.lit("{"), *_joined([F.concat(F.lit(json.dumps(k) + ": "), _literal(col(v))) for k, v in pairs]), F.lit("}"))


def _joined(items: list[Column]) -> list[Column]:
    out: list[Column] = []
    for i, x in enumerate(items):
        out += ([F.lit(", ")] if i else []) + [x]
    return out


def _literal(x: Column) -> Column:
    """JSON text of one value; to_json escapes text."""
    made = F.to_json(F.struct(x.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(made, F.lit(6), F.char_length(made) - 6)


def json_quote(s: Col) -> Column:
    return F.when(_text(s).isNotNull(), _literal(_text(s)))


def json_unquote(s: Col) -> Column:
    """Text that is no JSON string comes back unchanged."""

    def run(text: str | None) -> str | None:
        value = _load(text) if text and text[:1] == '"' else _MISSING
        return value if isinstance(value, str) else text

    return _apply(StringType(), run, _text(s))


def json_extract(j: Col, *paths: str) -> Column:
    """One plain path: the value's text. Several paths or wildcards: an array of all matches."""
    steps = [parse_path(p) for p in paths]
    many = len(paths) > 1 or any(s[0] in ("any", "each", "deep") or (s[0] == "at" and s[2]) for s in steps[0])

    def run(value: Any) -> str | None:
        found = [v for s in steps for _, v in _walk(value, s)]
        return None if not found else _loose(found if many else found[0])

    return _on_document(StringType(), run, j)


def json_value(j: Col, path: str) -> Column:
    """A scalar's text; true and false are 1 and 0; NULL for objects, arrays and null."""
    steps = parse_path(path)

    def run(value: Any) -> str | None:
        for _, v in _walk(value, steps):
            if not isinstance(v, (dict, list)):
                return None if v is None else str(int(v)) if isinstance(v, bool) else v if isinstance(v, str) else _loose(v)
        return None

    return _on_document(StringType(), run, j)


def json_query(j: Col, path: str) -> Column:
    """An object or array's text; NULL for scalars."""
    steps = parse_path(path)
    return _on_document(StringType(), lambda value: next((_loose(v) for _, v in _walk(value, steps) if isinstance(v, (dict, list))), None), j)


def json_exists(j: Col, path: str) -> Column:
    steps = parse_path(path)
    return _on_document(LongType(), lambda value: int(bool(_walk(value, steps))), j)


def json_contains_path(j: Col, mode: str, *paths: str) -> Column:
    steps = [parse_path(p) for p in paths]
    test = any if mode.lower() == "one" else all
    return _on_document(LongType(), lambda value: int(test(bool(_walk(value, s)) for s in steps)), j)


def _contains(value: Any, part: Any) -> bool:
    if isinstance(value, list):
        return all(any(_contains(v, p) for v in value) for p in part) if isinstance(part, list) else any(_contains(v, part) for v in value)
    if isinstance(value, dict):
        return isinstance(part, dict) and all(k in value and _contains(value[k], p) for k, p in part.items())
    return not isinstance(part, (dict, list)) and _same(value, part)


def _same(a: Any, b: Any) -> bool:
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return a == b and isinstance(a, str) == isinstance(b, str)


def json_contains(j: Col, candidate: Column | str, path: str = "$") -> Column:
    steps = parse_path(path)

    def run(value: Any, text: str | None) -> int | None:
        part, found = _load(text), _walk(value, steps)
        return None if part is _MISSING or not found else int(_contains(found[0][1], part))

    return _on_document(LongType(), run, j, _value(candidate))


def json_depth(j: Col) -> Column:
    def depth(v: Any) -> int:
        children = v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()
        return 1 + max(map(depth, children), default=0)

    return _on_document(LongType(), depth, j)


def _normal(v: Any) -> Any:
    if isinstance(v, dict):
        return {k: _normal(v[k]) for k in sorted(v)}
    if isinstance(v, list):
        return [_normal(x) for x in v]
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def json_normalize(j: Col) -> Column:
    """Sorted keys, no blanks, numbers in one form."""
    return _on_document(StringType(), lambda v: re.sub(r"(?<![\"\w.])(-?\d+(?:\.\d+)?)(?:e([+-]\d+))?(?![\"\w])", _power, _tight(_normal(v))), j)


def _power(m: re.Match) -> str:
    """Scientific form of a number: shortest digits, one before the point."""
    digits, exponent = f"{Decimal(m[0]).normalize():E}".split("E")
    return f"{digits if '.' in digits else digits + '.0'}E{int(exponent)}"


def json_equals(a: Col, b: Col) -> Column:
    def run(x: str | None, y: str | None) -> int | None:
        v, w = _load(x), _load(y)
        return None if v is _MISSING or w is _MISSING else int(_same(v, w))

    return _apply(LongType(), run, _text(a), _text(b))


def _overlap(a: Any, b: Any) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return any(k in b and _same(v, b[k]) for k, v in a.items())
    if isinstance(a, list) or isinstance(b, list):
        x, y = (v if isinstance(v, list) else [v] for v in (a, b))
        return any(_same(p, q) for p in x for q in y)
    return _same(a, b)


def json_overlaps(a: Col, b: Column | str) -> Column:
    def run(value: Any, text: str | None) -> int | None:
        other = _load(text)
        return None if other is _MISSING else int(_overlap(value, other))

    return _on_document(LongType(), run, a, _value(b))


def json_compact(j: Col) -> Column:
    return _on_document(StringType(), _tight, j)


def json_loose(j: Col) -> Column:
    return _on_document(StringType(), _loose, j)


def json_detailed(j: Col, tab: int = 4) -> Column:
    return _on_document(StringType(), lambda v: json.dumps(v, ensure_ascii=False, indent=tab), j)


def json_keys(j: Col, path: str = "$") -> Column:
    steps = parse_path(path)
    return _on_document(StringType(), lambda value: next((_loose(list(v)) for _, v in _walk(value, steps) if isinstance(v, dict)), None), j)


def json_length(j: Col, path: str = "$") -> Column:
    steps = parse_path(path)
    return _on_document(LongType(), lambda value: next((len(v) if isinstance(v, (dict, list)) else 1 for _, v in _walk(value, steps)), None), j)


def json_type(j: Col) -> Column:
    def run(v: Any) -> str:
        if v is None:
            return "NULL"
        return next(name for kind, name in ((bool, "BOOLEAN"), (dict, "OBJECT"), (list, "ARRAY"), (str, "STRING"), (int, "INTEGER"), (float, "DOUBLE")) if isinstance(v, kind))

    return _on_document(StringType(), run, j)


def _path_text(keys: tuple) -> str:
    return "$" + "".join(f"[{k}]" if isinstance(k, int) else f".{k}" if re.fullmatch(r"\w+", k) else f'."{k}"' for k in keys)


def json_search(j: Col, mode: str, pattern: str, escape: str = "\\", path: str = "$") -> Column:
    """Paths of strings that match a LIKE pattern: the first as a string, or all (several as an array)."""
    marks = re.findall(re.escape(escape) + r"(.)|(.)", pattern, re.S) if escape else [("", c) for c in pattern]
    shape = re.compile("".join(re.escape(e) if e else ".*" if c == "%" else "." if c == "_" else re.escape(c) for e, c in marks), re.S)
    steps = [*parse_path(path), ("deep",)]

    def run(value: Any) -> str | None:
        found = list(dict.fromkeys(_path_text(keys) for keys, v in _walk(value, steps) if isinstance(v, str) and shape.fullmatch(v)))
        if not found:
            return None
        return _loose(found[0] if mode.lower() == "one" or len(found) == 1 else found)

    return _on_document(StringType(), run, j)


def _edit(value: Any, steps: list[tuple], new: Callable[[], Any], change: bool, create: bool, insert: bool = False) -> Any:
    """Sets the place of a plain path; ``change`` an existing one, ``create`` a new one, ``insert`` before an index."""
    if not steps:
        return new() if change else value
    (kind, *rest), tail = steps[0], steps[1:]
    if kind == "key" and isinstance(value, dict):
        if rest[0] in value:
            return {**value, rest[0]: _edit(value[rest[0]], tail, new, change, create, insert)}
        return {**value, rest[0]: new()} if create and not tail else value
    if kind == "at":
        items = value if isinstance(value, list) else [value]
        i = _index(rest[0], len(items))
        if insert and not tail:
            return [*items[: max(0, i)], new(), *items[max(0, i) :]] if isinstance(value, list) else value
        if 0 <= i < len(items):
            made = [*items[:i], _edit(items[i], tail, new, change, create, insert), *items[i + 1 :]]
            return made if isinstance(value, list) else made[0]
        return [*items, new()] if create and not tail else value
    return value


def _edits(j: Col, pairs: tuple[tuple[str, Column | object], ...], how: Callable[[Any, list[tuple], Any], Any]) -> Column:
    paths = [parse_path(p) for p, _ in pairs]

    def run(value: Any, *news: Any) -> str:
        for steps, new in zip(paths, news, strict=True):
            value = how(value, steps, new)
        return _loose(value)

    return _on_document(StringType(), run, j, *[_value(v) for _, v in pairs], reads=False)


def json_insert(j: Col, *pairs: tuple[str, Column | object]) -> Column:
    return _edits(j, pairs, lambda v, s, n: _edit(v, s, lambda: n, False, True))


def json_replace(j: Col, *pairs: tuple[str, Column | object]) -> Column:
    return _edits(j, pairs, lambda v, s, n: _edit(v, s, lambda: n, True, False))


def json_set(j: Col, *pairs: tuple[str, Column | object]) -> Column:
    return _edits(j, pairs, lambda v, s, n: _edit(v, s, lambda: n, True, True))


def json_array_append(j: Col, *pairs: tuple[str, Column | object]) -> Column:
    """Appends to the array at the path; a scalar or object there becomes an array first."""

    def how(value: Any, steps: list[tuple], new: Any) -> Any:
        found = _walk(value, steps)
        if not found:
            return value
        old = found[0][1]
        return _edit(value, steps, lambda: [*(old if isinstance(old, list) else [old]), new], True, False)

    return _edits(j, pairs, how)


def json_array_insert(j: Col, *pairs: tuple[str, Column | object]) -> Column:
    return _edits(j, pairs, lambda v, s, n: _edit(v, s, lambda: n, False, False, insert=True))


def json_remove(j: Col, *paths: str) -> Column:
    def drop(value: Any, steps: list[tuple]) -> Any:
        (kind, *rest), tail = steps[0], steps[1:]
        if kind == "key" and isinstance(value, dict) and rest[0] in value:
            return {k: drop(v, tail) if k == rest[0] and tail else v for k, v in value.items() if tail or k != rest[0]}
        if kind == "at" and isinstance(value, list) and 0 <= (i := _index(rest[0], len(value))) < len(value):
            return [*value[:i], *([drop(value[i], tail)] if tail else []), *value[i + 1 :]]
        return value

    parsed = [parse_path(p) for p in paths]

    def run(value: Any) -> str:
        for steps in parsed:
            value = drop(value, steps) if steps else value
        return _loose(value)

    return _on_document(StringType(), run, j, reads=False)


def _merged(a: Any, b: Any) -> Any:
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: _merged(a[k], b[k]) if k in a and k in b else a.get(k, b.get(k)) for k in [*a, *[k for k in b if k not in a]]}
    return [*(a if isinstance(a, list) else [a]), *(b if isinstance(b, list) else [b])]


def _patched(a: Any, b: Any) -> Any:
    if not isinstance(b, dict):
        return b
    out = dict(a) if isinstance(a, dict) else {}
    for k, v in b.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = _patched(out.get(k), v)
    return out


def _fold(step: Callable[[Any, Any], Any], docs: tuple[Col, ...]) -> Column:
    def run(*texts: str | None) -> str | None:
        values = [_load(t) for t in texts]
        if any(v is _MISSING for v in values):
            return None
        out = values[0]
        for v in values[1:]:
            out = step(out, v)
        return _loose(out)

    return _apply(StringType(), run, *[_text(d) for d in docs])


def json_merge_preserve(*docs: Col) -> Column:
    return _fold(_merged, docs)


json_merge = json_merge_preserve


def json_merge_patch(*docs: Col) -> Column:
    return _fold(_patched, docs)
