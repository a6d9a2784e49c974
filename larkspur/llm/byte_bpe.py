"""Operator 8: byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before encoding where the splitting pattern has a match boundary whatever
surrounds it (``safe_parts``), so one call never holds the regex state of a whole book; the ids are
those of one call on the whole text. Decoding concatenates the tokens' raw bytes and never goes
through a lossy character decoding.

Everything is a map over rows: no shuffle, and memory is bounded by one Arrow batch and the longest
text's own outputs; results leave a worker about every megabyte.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import map_arrow, quoted

PART_CHARS, FLUSH_BYTES, MAX_RANKS = 1 << 16, 1 << 20, 1 << 26

#: Places where a match always ends: before white space after anything else, and between ASCII letters and digits.
_SAFE = re.compile(r"(?<=\S)(?=[ \n\t\r])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def safe_parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, cut at match boundaries of the pattern only.

    A part is longer where no such boundary follows (one unbroken run of letters, say).
    """
    begin = 0
    while len(text) - begin > size:
        at = _SAFE.search(text, begin + size)
        if at is None:
            break
        yield text[begin : at.start()]
        begin = at.start()
    yield text[begin:] if begin else text


class Codec:
    """Encoder and decoder of one rank file; built once in each Python worker."""

    def __init__(self, raw: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.digits = [str(i).encode() for i in range(max(ranks.values()) + 1)]

    def parts(self, text: str | None) -> Iterator[list[int]]:
        """The ids of the text's parts, in order."""
        if text:
            for part in safe_parts(text):
                yield self.encoding.encode_ordinary(part)

    def encode(self, text: str | None) -> list[int]:
        return [i for part in self.parts(text) for i in part]

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(raw: bytes, pattern: str) -> Codec:
    """The codec of a rank file's bytes; a process keeps the last one."""
    key = hashlib.sha256(raw).hexdigest(), pattern
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(raw, pattern)
    return _CODECS[key]


_OUT = {"ids": "array<int>", "decoded": "binary", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Encodes every whole text, without special tokens, and decodes the ids again.

    ``path``: the rank file, read by the driver and sent to the executors (at most ``MAX_RANKS``
    bytes). ``outputs``: any of ids (array of int), decoded (the bytes of the decoded ids), n_tokens,
    ids_sha256 (digest of the decimal ids joined by a space), decoded_sha256. Returns ``id_col`` and
    these columns, one row for each input row; an output of the name of ``id_col`` is refused.

    Null and empty texts have no ids and decode to no bytes. Ids (null and repeated ones too) are
    carried along unread; other columns are left out. An empty table gives an empty result. A very
    long text goes through in parts; only what ``outputs`` asks for is held of it.
    """
    for name in outputs:
        if name not in _OUT or name.lower() == id_col.lower():
            raise ValueError(f"no output can be named {name}")
    kind = docs.schema[id_col].dataType.simpleString()
    raw = Path(path).read_bytes()
    if len(raw) > MAX_RANKS:
        raise ValueError(f"{path} is no rank file: it has more than {MAX_RANKS} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    def row(c: Codec, text: str | None) -> tuple[dict, int]:
        n, ids, back = 0, [], []
        of_ids, of_bytes = hashlib.sha256(), hashlib.sha256()
        for listed in c.parts(text):
            if "ids_sha256" in outputs:
                of_ids.update(b" " * (n > 0) + b" ".join(map(c.digits.__getitem__, listed)))
            n += len(listed)
            if "decoded" in outputs or "decoded_sha256" in outputs:
                data = c.decode(listed)
                of_bytes.update(data)
                if "decoded" in outputs:
                    back.append(data)
            if "ids" in outputs:
                ids.append(np.array(listed, np.int32))
        whole, data = np.concatenate(ids) if ids else np.zeros(0, np.int32), b"".join(back)
        return {"ids": whole, "decoded": data, "n_tokens": n, "ids_sha256": of_ids.hexdigest(), "decoded_sha256": of_bytes.hexdigest()}, whole.nbytes + len(data) + 256

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, pattern)
        texts = batch.column(1)
        done, size = 0, 0
        made: dict[str, list] = {name: [] for name in outputs}

        def flush(upto: int) -> pa.RecordBatch:
            arrays = [_lists(made[name]) if name == "ids" else pa.array(made[name], type=_ARROW[name]) for name in outputs]
            for values in made.values():
                values.clear()
            return pa.RecordBatch.from_arrays([batch.column(0).slice(done, upto - done), *arrays], names=[id_col, *outputs])

        for i in range(batch.num_rows):
            found, more = row(c, texts[i].as_py())
            for name in outputs:
                made[name].append(found[name])
            size += more
            if size > FLUSH_BYTES:
                yield flush(i + 1)
                done, size = i + 1, 0
        if done < batch.num_rows:
            yield flush(batch.num_rows)

    return map_arrow(docs.select(F.col(quoted(id_col)), F.col(quoted(text_col))), run, ", ".join([f"{quoted(id_col)} {kind}", *[f"{n} {_OUT[n]}" for n in outputs]]))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts)))


_ARROW = {"decoded": pa.binary(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
