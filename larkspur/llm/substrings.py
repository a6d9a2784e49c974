"""Operator 10: substring dedup by level-wise doubling.

A word is removed when it lies in a window of ``length`` words that also starts in a document with a
smaller id. Windows are found level by level, from a quarter of the length up (13, 25, 50 words). At
the first level only *selected* windows are looked at, the smallest hash in each window of the full
length: what two documents have in common is selected in both, because the choice depends on the
full window alone. What occurs in one document only ends there; what is repeated is extended to
twice its length inside the same full windows, and so on until no candidate survives or the full
length is reached. Longer repeats are covered by windows of that length, so nothing is gained beyond.

Documents whose words equal those of a document with a smaller id are settled as a whole, so groups
of exact copies bring no windows. Everything else is keyed by hashes: minima are combined map-side
and written before they are joined, so both sides of a look-up are shuffled and adaptive execution
splits hot keys. No document or window list is collected; texts are shuffled once for the documents
with candidates at the first level, again for those of each later one, and once for the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import cut, discard, map_arrow, quoted
from larkspur.llm.words import Block, blocks, mix, window_hashes, word_hashes

LENGTH = 50


def _row_tags(block: Block, words: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each text's whole word sequence."""
    out = []
    for family in (0, 1):
        spread = mix(words[family] + mix(np.arange(len(words[family]), dtype=np.uint64) - np.repeat(block.word_at[:-1], block.counts()).astype(np.uint64)))
        total = np.zeros(len(spread) + 1, dtype=np.uint64)
        np.cumsum(spread, out=total[1:])
        out.append(mix(total[block.word_at[1:]] - total[block.word_at[:-1]] + block.counts().astype(np.uint64)))
    return out[0], out[1]


def levels(length: int) -> list[int]:
    """Window lengths, each (about) twice the one before it: a quarter, a half, the whole."""
    return sorted({-(-length // 4), -(-length // 2), length})


def owners(block: Block, hashes: np.ndarray, seed: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all ``length``-word windows, of the ``seed``-word window that is selected in each, and the seed windows' hashes.

    Selected is the smallest hash among a window's seed windows; of equal ones the last.
    """
    n = len(hashes)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    small = window_hashes(hashes, seed)
    stretch = length - seed + 1
    best, where = small.copy(), np.arange(len(small))
    have = 1
    while have < stretch:  # doubling minima; the later one wins ties
        step = min(have, stretch - have)
        a, b = best[:-step], best[step:]
        later = b <= a
        best, where = np.where(later, b, a), np.where(later, where[step:], where[:-step])
        have += step
    begin = np.flatnonzero(block.left()[: len(where)] >= length)
    return begin, where[begin], small


def extended(begin: np.ndarray, owner: np.ndarray, length: int, size: int) -> np.ndarray:
    """Where each full window's candidate of ``size`` words starts: at the selected one, or earlier so as to end with the window."""
    return np.minimum(owner, begin + length - size)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _probe(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """Rows (key, check, doc, at): whole texts (at has bit 62 set) and selected windows (at: position).

    ``at`` holds the position in its upper and a tag of the text in its lower 32 bits, so rows that
    share an id but not a text stay apart.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in blocks(batch.column(1)):
            words = word_hashes(block, 0), word_hashes(block, 1)
            t0, t1 = _row_tags(block, words)
            tag = (t0 & np.uint64(0xFFFFFFFF)).astype(np.int64)
            ids = batch.column(0).slice(block.first, block.n)
            enough = np.flatnonzero(block.counts() >= length)
            _, at, small = owners(block, words[0], seed, length)
            at = np.unique(at)
            key = small[at]
            text = np.searchsorted(block.word_at, at, side="right") - 1
            position = at - block.word_at[text]
            rows = np.concatenate([enough, text])
            yield pa.RecordBatch.from_arrays(
                [
                    _long(np.concatenate([t0[enough], key])),
                    _long(np.concatenate([t1[enough], np.zeros(len(at), np.uint64)])),
                    ids.take(pa.array(rows)),
                    pa.array(np.concatenate([(1 << 62) | tag[enough], (position << 32) | tag[text]])),
                ],
                names=["key", "check", "doc", "at"],
            )

    return map_arrow(docs, run, "key bigint, check bigint, doc bigint, at bigint").where(F.col("doc").isNotNull())


def _repeated(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows (a written table) whose key occurs in more than one document, with ``low``, the smallest such id; and the table of those ids.

    Minima are combined map-side and written; in the join both sides then have a shuffle of their
    own, so adaptive execution splits the rows of a key that very many share.
    """
    low = cut(rows.groupBy(*keys).agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").drop("high"))
    return rows.join(low, keys), low


_TEXTS = "doc bigint, tag bigint, packed binary"


def _packed(docs: DataFrame) -> DataFrame:
    """Texts keyed by (doc, tag), compressed for the shuffle."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for block in blocks(batch.column(1)):
            t0, _ = _row_tags(block, (word_hashes(block, 0), word_hashes(block, 1)))
            ids = batch.column(0).slice(block.first, block.n)
            texts = [packer.compress(block.data[a:b].tobytes()) for a, b in zip(block.offsets[:-1], block.offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array((t0 & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(texts, pa.binary())], names=["doc", "tag", "packed"])

    return map_arrow(docs, run, _TEXTS)


def _unpacked(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Texts in runs of about 4 MB, with the row at which each run begins."""
    unpacker, texts, begin, size = zstandard.ZstdDecompressor(), [], 0, 0
    for i, x in enumerate(column):
        texts.append(unpacker.decompress(x.as_py()))
        size += len(texts[-1])
        if size > 1 << 22:
            yield begin, pa.array(texts, pa.large_binary())
            texts, begin, size = [], i + 1, 0
    if texts:
        yield begin, pa.array(texts, pa.large_binary())


def _windows(candidates: DataFrame, length: int, sizes: tuple[int, int, int]) -> DataFrame:
    """Rows (key, check, doc, at) of candidates of the last of ``sizes`` words; key and check have 96 bits.

    ``sizes``: of the first level, of the level before, whose repeated positions are ``places``, and
    of this one.
    """
    seed, before, size = sizes

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, texts in _unpacked(batch.column(2)):
            for block in blocks(texts):
                words = word_hashes(block, 0), word_hashes(block, 1)
                known = np.zeros(len(words[0]) + 1, dtype=bool)
                for i in range(block.n):
                    known[np.asarray(batch.column(3)[first + block.first + i].values) + block.word_at[i]] = True
                begin, owner, _ = owners(block, words[0], seed, length)
                alive = known[extended(begin, owner, length, before)]
                begin = np.unique(extended(begin[alive], owner[alive], length, size))
                keys = [window_hashes(w, size, f)[begin] for f, w in enumerate(words)]
                text = np.searchsorted(block.word_at, begin, side="right") - 1
                tags = batch.column(1).to_numpy(zero_copy_only=False)[first + block.first + text]
                yield pa.RecordBatch.from_arrays([_long(keys[0]), pa.array((keys[1] >> np.uint64(32)).astype(np.int64)), batch.column(0).take(pa.array(first + block.first + text)), pa.array(((begin - block.word_at[text]) << 32) | tags)], names=["key", "check", "doc", "at"])

    return map_arrow(candidates.select("doc", "tag", "packed", "places"), run, "key bigint, check bigint, doc bigint, at bigint")


def _tag() -> Column:
    return F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))


def _places(rows: DataFrame) -> DataFrame:
    """Positions of each text (at most its words) as one array."""
    return rows.groupBy("doc", _tag().alias("tag")).agg(F.collect_set(F.shiftright("at", 32).cast("int")).alias("places"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """``id_col``, n_words, n_removed, kept_sha256 and, with ``texts``, kept: the kept words joined by one space.

    Words are runs outside blanks, unchanged; windows are judged on the input. Texts of fewer than
    ``length`` words lose none. Null and empty texts have no words and an empty result. Repeated
    rows of one id never remove each other's words (no id is smaller), but rows of larger ids do
    lose what they share. Rows with a null id have no order: they neither lose nor remove words.
    Ids are integers. Other columns are left out; an empty table gives an empty result. ``id_col``
    may not have the name of an output.
    """
    if id_col.lower() in ("n_words", "n_removed", "kept_sha256", "kept"):
        raise ValueError(f"the id column can't be named {id_col}")
    sizes = levels(length)
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc"), F.col(quoted(text_col)).alias("text"))
    probe = cut(_probe(rows, length, sizes[0]))
    both, low = _repeated(probe, ["key", "check"])
    found = cut(both)
    discard(probe, low)
    is_text = F.col("at").bitwiseAND(F.lit(1 << 62)) != 0
    copies = cut(found.where(is_text & (F.col("doc") > F.col("low"))).select("doc", _tag().alias("tag")).distinct())
    places = cut(_places(found.where(~is_text & (F.lit(len(sizes) > 1) | (F.col("doc") > F.col("low"))))).join(copies, ["doc", "tag"], "left_anti"))
    discard(found)
    packed = _packed(rows)
    texts_of = packed
    for before, size in zip(sizes, sizes[1:], strict=False):
        if places.isEmpty():  # no candidate survives
            break
        candidates = cut(texts_of.join(places, ["doc", "tag"]))
        windows = cut(_windows(candidates, length, (sizes[0], before, size)))
        both, low = _repeated(windows, ["key", "check"])
        # Below the full length the smallest document's windows go on too: the next level compares with them.
        longer = cut(_places(both if size < length else both.where(F.col("doc") > F.col("low"))))
        discard(places, windows, low, *([texts_of] if texts_of is not packed else []))
        places, texts_of = longer, candidates.drop("places")
        texts_of._cut = candidates._cut
    if texts_of is not packed:
        discard(texts_of)
    doomed = places
    # A whole copy loses every word; it is marked by a null array.
    marks = doomed.withColumn("all", F.lit(False)).unionByName(copies.select("doc", "tag", F.lit(None).cast("array<int>").alias("places"), F.lit(True).alias("all")))
    joined = packed.join(marks, ["doc", "tag"], "left").select("doc", "packed", "places", F.coalesce("all", F.lit(False)).alias("all"))
    schema = f"{quoted(id_col)} bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * texts

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        every = batch.column(3).to_pylist()
        for first, part in _unpacked(batch.column(1)):
            for block in blocks(part):
                n = len(block.starts)
                edge = np.zeros(n + 1, dtype=np.int32)
                for i in range(block.n):
                    row = first + block.first + i
                    if every[row]:
                        edge[block.word_at[i]] += 1
                        edge[block.word_at[i + 1]] -= 1
                    elif batch.column(2)[row].is_valid:
                        at = np.asarray(batch.column(2)[row].values) + block.word_at[i]
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + length, -1)
                gone = np.cumsum(edge[:n]) > 0
                kept = []
                for i in range(block.n):
                    a, z = block.word_at[i], block.word_at[i + 1]
                    raw = block.data[block.offsets[i] : block.offsets[i + 1]].tobytes().split()
                    if len(raw) != z - a:
                        raise ValueError("word counts differ")
                    kept.append(b" ".join([w for w, g in zip(raw, gone[a:z], strict=True) if not g]) if gone[a:z].any() else b" ".join(raw))
                total = np.concatenate([[0], np.cumsum(gone)])
                ids = batch.column(0).slice(first + block.first, block.n)
                arrays = [ids, pa.array(block.counts()), pa.array(total[block.word_at[1:]] - total[block.word_at[:-1]]), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array([k.decode() for k in kept])] * texts, names=[id_col, "n_words", "n_removed", "kept_sha256"] + ["kept"] * texts)

    return map_arrow(joined, run, schema)
