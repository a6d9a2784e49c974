"""Operator 2: quality rules by repetition coverage.

Rolling hashes of several n-gram lengths, in numpy over whole blocks of texts, mark the words that
lie in an n-gram found twice or more in the same text; the measure is the share of the text's word
characters in marked words, and the share of its line characters in lines equal to an earlier line.

A map over rows: no shuffle, and memory depends on the longest text only. The hashes have 64 bits
and are compared within one text, so a false repeat needs a collision within one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import map_arrow, quoted
from larkspur.llm.words import Block, blocks, mix, window_hashes, word_hashes

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = " \t\n\v\f\r"


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict. ``coverage``: n-gram length to the largest share of word characters in repeated n-grams."""

    min_words: int = 20
    #: Base rule: percent of words in repeated windows of ``base_window`` words.
    base_window: int = 8
    base_percent: int = 30
    coverage: dict[int, float] = field(default_factory=lambda: {5: 0.45, 8: 0.35, 12: 0.35})
    duplicate_lines: float = 0.40
    #: Largest ratio of symbol characters to words.
    symbols: float = 0.25


def repeated(block: Block, hashes: np.ndarray, n: int) -> np.ndarray:
    """Marks the words of ``block`` in an ``n``-word window found twice or more in the same text."""
    words = len(block.starts)
    windows = window_hashes(hashes, n)
    if not len(windows):
        return np.zeros(words, dtype=bool)
    text = np.repeat(np.arange(block.n), block.counts())[: len(windows)]
    at = np.flatnonzero(block.left()[: len(windows)] >= n)
    keys = mix(windows[at] + mix(text[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(words + 1, dtype=np.int32)
    begin = at[twice]
    edge[begin] += 1
    np.subtract.at(edge, begin + n, 1)
    return np.cumsum(edge[:-1]) > 0


def duplicate_lines(text: str) -> tuple[int, int, int]:
    """Lines with a word that equal an earlier line, their characters, and the characters of all lines with a word."""
    seen: set[str] = set()
    n = size = total = 0
    for line in text.split("\n"):
        if line.strip(_BLANK):
            total += len(line)
            if line in seen:
                n += 1
                size += len(line)
            else:
                seen.add(line)
    return n, size, total


def measure(block: Block, rules: Rules) -> dict[str, np.ndarray]:
    hashes = word_hashes(block)
    n_words = block.counts()
    is_char = (block.data & 0xC0) != 0x80
    chars = np.zeros(len(block.data) + 1, dtype=np.int64)
    np.cumsum(is_char, out=chars[1:])
    length = chars[block.ends] - chars[block.starts]
    of_words = np.zeros(len(length) + 1, dtype=np.int64)
    np.cumsum(length, out=of_words[1:])
    word_chars = of_words[block.word_at[1:]] - of_words[block.word_at[:-1]]
    lines = np.array([duplicate_lines(block.data[a:b].tobytes().decode()) for a, b in zip(block.offsets[:-1], block.offsets[1:], strict=True)], dtype=np.int64).reshape(-1, 3)
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": block.per_text(_SYMBOL[block.data]), "n_dup_lines": lines[:, 0]}
    share = np.maximum(word_chars, 1)
    fine = np.ones(block.n, dtype=bool)
    for n in sorted({rules.base_window, *rules.coverage}):
        marked = repeated(block, hashes, n)
        if n == rules.base_window:
            total = np.concatenate([[0], np.cumsum(marked)])
            out["n_repeat_words"] = total[block.word_at[1:]] - total[block.word_at[:-1]]
        if n in rules.coverage:
            total = np.concatenate([[0], np.cumsum(np.where(marked, length, 0))])
            out[f"coverage_{n}"] = (total[block.word_at[1:]] - total[block.word_at[:-1]]) / share
            fine &= out[f"coverage_{n}"] <= rules.coverage[n]
    out["dup_line_share"] = lines[:, 1] / np.maximum(lines[:, 2], 1)
    out["base_failed"] = (n_words < rules.min_words) | (100 * out["n_repeat_words"] > rules.base_percent * n_words)
    out["kept"] = ~out["base_failed"] & fine & (out["dup_line_share"] <= rules.duplicate_lines) & (out["n_symbols"] <= rules.symbols * n_words)
    return out


def _columns(rules: Rules) -> dict[str, str]:
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return dict.fromkeys(longs, "bigint") | {f"coverage_{n}": "double" for n in sorted(rules.coverage)} | {"dup_line_share": "double", "base_failed": "boolean", "kept": "boolean"}


def judge_quality(docs: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Judges every whole text: ``id_col``, the counts, the coverage of each n-gram length, base_failed and kept.

    Counts are those of the module's rules; coverage_N is the share of word characters inside
    N-word windows found twice or more, dup_line_share the share of line bytes in repeated lines.
    A text is kept when it passes the base rules and every limit of ``rules``.

    Null and empty texts, and texts of white space only, have zero counts and fail the base rules.
    Ids (null and repeated too) are carried along; repeated rows get equal rows; other columns are
    left out; an empty table gives an empty result. ``id_col`` may not have the name of a count.
    """
    rules = rules or Rules()
    if id_col.lower() in _columns(rules):
        raise ValueError(f"the id column can't be named {id_col}")
    kind = docs.schema[id_col].dataType.simpleString()
    columns = _columns(rules)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in blocks(batch.column(1)):
            found = measure(block, rules)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n), *[pa.array(found[c], type=_ARROW[t]) for c, t in columns.items()]], names=[id_col, *columns])

    return map_arrow(docs.select(F.col(quoted(id_col)), F.col(quoted(text_col))), run, ", ".join([f"{quoted(id_col)} {kind}", *[f"{c} {t}" for c, t in columns.items()]]))


def keep_quality(docs: DataFrame, rules: Rules | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text passes, with all their columns: one pass, no shuffle."""
    rules = rules or Rules()
    where = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in blocks(batch.column(where)):
            yield batch.slice(block.first, block.n).filter(pa.array(measure(block, rules)["kept"]))

    return map_arrow(docs, run, docs.schema)


_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
