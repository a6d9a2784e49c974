"""Operator 3: WARC archives with a two-level capture index.

``write_archives`` writes gzip members, one for each record, into files of the shared folder and
returns where each lies. ``build_index`` sorts the captures by reversed-host URL key into compressed
blocks; the sparse directory has one entry a block. A directory of more than ``ROOT_ROWS`` entries is
itself cut into blocks, with a directory of its own, so what a look-up holds is bounded. Look-ups
(``CaptureIndex`` for one, ``fetch_captures`` for a table of them) binary-search the directory, then
a block, then read the record's byte range; ``read_archives`` reads everything, block by block.

Files are named anew by each attempt of a task, and only the rows of successful attempts are kept
(as a written table), so a retried or speculative task leaves at most an unused file behind.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import cut, discard, file_system, quoted, shared_folder
from larkspur.llm.urls import host_of

MIN_REVISIT, BLOCK_CAPTURES, ROOT_ROWS, FLUSH_BYTES, DATE = 1000, 1000, 4096, 1 << 22, "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """Reversed-host key: ``https://a.b.org/x?y`` is ``org,b,a)/x?y``; null is empty."""
    tail = F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^#]*)", 1), F.lit(""))
    return F.concat(F.array_join(F.reverse(F.split(host_of(url), r"\.")), ","), F.lit(")"), tail)


def with_references(pages: DataFrame, id_col: str, body_col: str, least: int = MIN_REVISIT) -> tuple[DataFrame, DataFrame]:
    """``pages`` with _digest, _bytes and _refers (the page that holds an equal payload; null for responses).

    Of equal payloads of at least ``least`` bytes the one with the largest id is the response; rows
    that share that id are all responses. Only (digest, id) pairs are aggregated, with map-side
    maxima. In the join with the table of repeated digests only the pages' side can be skewed, and
    adaptive execution splits the rows of one payload over tasks (or broadcasts the written table,
    if its size allows). Also returns that table.
    """
    rows = pages.withColumn("_digest", F.sha1(F.coalesce(F.col(body_col), F.lit("")))).withColumn("_bytes", F.coalesce(F.octet_length(F.col(body_col)), F.lit(0)).cast("long"))
    narrow = rows.where(F.col("_bytes") >= least).groupBy("_digest").agg(F.max(F.col(id_col)).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    known = cut(narrow.select("_digest", "_first"))
    joined = rows.join(known, "_digest", "left")
    refers = F.when((F.col("_bytes") >= least) & (F.col("_first").isNotNull()) & (F.col(id_col).isNull() | (F.col(id_col) != F.col("_first"))), F.col("_first"))
    return joined.withColumn("_refers", refers).drop("_first"), known


def _header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _safe(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url or "")


def record(page_id: int | None, url: str | None, body: bytes, digest: str, refers: int | None, size: int) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP header only, which tells the payload's full length."""
    revisit = refers is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    content = http if revisit else http + body
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", _safe(url)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:page:{refers}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(content)))]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(_header(fields) + content + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> dict:
    """The fields of a record's bytes and its payload (None for a revisit); checks lengths and, for a response, the digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(fields["Content-Length"])
    content = rest[:size]
    if len(content) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = content.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a payload differs from its digest")
    number = lambda k: int(v) if (v := fields.get(k, "")[len("<urn:page:") : -1]) else None
    return {"page_id": number("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": number("WARC-Refers-To"), "payload": payload if kind == "response" else None}


class _Appender:
    """Appends byte strings to one new file."""

    def __init__(self, folder: str, suffix: str):
        self.url = f"{folder}/{uuid.uuid4().hex}{suffix}"
        fs, path = file_system(self.url)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.stream, self.at = fs.open_output_stream(path, compression=None), 0

    def add(self, data: bytes) -> int:
        begin = self.at
        self.stream.write(data)
        self.at += len(data)
        return begin


_CAPTURE = "page_id bigint, key string, file string, at bigint, size bigint"
_ENTRY = "key string, page_id bigint, last_key string, last_page bigint, file string, at bigint, size bigint, captures bigint"
_ENTRY_NAMES = [x.split()[0] for x in _ENTRY.split(", ")]
_ENTRY_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = MIN_REVISIT) -> DataFrame:
    """Writes a record for each row and returns page_id, key, file, at, size: where each record lies.

    Payloads are the bodies in UTF-8 (null: empty). Null ids and urls are written as empty fields;
    control characters and blanks of urls are percent-encoded in the record header. Repeated rows
    get records of their own. Other columns are left out; an empty table writes no file.
    """
    folder = shared_folder(pages.sparkSession) + "/warc"
    rows = pages.select(F.col(quoted(id_col)).cast("long").alias("page_id"), F.col(quoted(url_col)).alias("url"), F.col(quoted(body_col)).alias("html"))
    rows, known = with_references(rows, "page_id", "html", least)
    rows = rows.select("page_id", "url", "html", "_digest", "_refers", "_bytes", url_key(F.col("url")).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            if out is None and batch.num_rows:
                out = _Appender(folder, ".warc.gz")
            at, size = [], []
            for page, url, html, digest, refers, length in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                data = record(page, url, (html or "").encode(), digest, refers, length)
                at.append(out.add(data))
                size.append(len(data))
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(6), pa.array([out.url] * len(at)), pa.array(at, pa.int64()), pa.array(size, pa.int64())], names=["page_id", "key", "file", "at", "size"])
        if out is not None:
            out.stream.close()

    captures = cut(rows.mapInArrow(run, _CAPTURE))
    discard(known)
    return captures


def _order(key: str, page: int | None) -> tuple:
    """The order in which Spark sorts (key, page_id): code points are in the order of their UTF-8 bytes, nulls come first."""
    return key, page is not None, page or 0


@dataclass(frozen=True)
class Index:
    """The top of a capture index: at most ``ROOT_ROWS`` entries [key, page_id, last_key, last_page, file, at, size, captures] of blocks, and how many levels of blocks lie below."""

    root: list[list]
    levels: int
    #: All blocks of captures, one row each.
    blocks: DataFrame | None = None


def _pack(entries: DataFrame, folder: str, per_block: int) -> DataFrame:
    """Entries in sorted order written as compressed blocks; returns an entry for each block.

    Ranges are cut by (key, page_id, file, at), so a key with very many captures spreads over tasks.
    """
    order = ["key", "page_id", "file", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, waiting, made = None, [], []

        def write() -> None:
            nonlocal out
            out = out or _Appender(folder, ".cdx.z")
            data = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in waiting).encode(), 6)
            made.append((*waiting[0][:2], *waiting[-1][2:4], out.url, out.add(data), len(data), sum(x[7] for x in waiting)))
            waiting.clear()

        def flush() -> pa.RecordBatch:
            columns = [pa.array(x, t) for x, t in zip(zip(*made, strict=True), _ENTRY_TYPES, strict=True)]
            made.clear()
            return pa.RecordBatch.from_arrays(columns, names=_ENTRY_NAMES)

        for batch in batches:
            for entry in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                waiting.append(entry)
                if len(waiting) == per_block:
                    write()
                    if len(made) == 1000:
                        yield flush()
        if waiting:
            write()
        if made:
            yield flush()
        if out is not None:
            out.stream.close()

    return cut(entries.select(*_ENTRY_NAMES).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _ENTRY))


def build_index(captures: DataFrame, block_captures: int = BLOCK_CAPTURES, root_rows: int = ROOT_ROWS) -> Index:
    """Sorts captures by key and writes the blocks and as many levels of directory as leave at most ``root_rows`` entries at the top.

    Null ids sort first; captures of one key and id stay apart by file and place, so repeated rows
    are all kept; no captures give an empty index.
    """
    folder = shared_folder(captures.sparkSession) + "/index"
    entries = captures.withColumn("last_key", F.col("key")).withColumn("last_page", F.col("page_id")).withColumn("captures", F.lit(1).cast("long"))
    blocks = top = _pack(entries, folder, block_captures)
    levels = 1
    while top.count() > root_rows:
        above = _pack(top, folder, max(2, min(block_captures, root_rows)))
        if top is not blocks:
            discard(top)
        top, levels = above, levels + 1
    root = sorted(([*r] for r in top.collect()), key=lambda e: (_order(*e[:2]), e[4:6]))  # at most root_rows
    return Index(root, levels, blocks)


class _Ranges:
    """Range reads, keeping the last few files open."""

    def __init__(self) -> None:
        self.open: dict = {}

    def read(self, url: str, at: int, size: int) -> bytes:
        if url not in self.open:
            if len(self.open) >= 16:
                self.open.pop(next(iter(self.open))).close()
            fs, path = file_system(url)
            self.open[url] = fs.open_input_file(path)
        return self.open[url].read_at(size, at)


def _entries(ranges: _Ranges, file: str, at: int, size: int) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(ranges.read(file, at, size)).decode().split("\n")]


class CaptureIndex:
    """Look-ups on the driver or in a task; holds the top of the index and the last few blocks."""

    def __init__(self, index: Index):
        self.root, self.levels = index.root, index.levels
        self.ranges = _Ranges()
        self.blocks: OrderedDict = OrderedDict()
        self.read_blocks = 0

    def _block(self, where: tuple) -> list[list]:
        if where not in self.blocks:
            self.blocks[where] = _entries(self.ranges, *where)
            self.read_blocks += 1
            while len(self.blocks) > 8:
                self.blocks.popitem(last=False)
        self.blocks.move_to_end(where)
        return self.blocks[where]

    def find(self, key: str, *page: int | None, skip: int = 0) -> Iterator[tuple[str, int, int]]:
        """File, place and length of each record with this key (and this page_id, if given), by binary search of directory and blocks; without the first ``skip``."""
        low, high = (_order(key, *page), _order(key, *page)) if page else ((key,), (key, 2))

        def walk(entries: list[list], level: int) -> Iterator[list]:
            nonlocal skip
            i = bisect_left(entries, low, key=lambda e: _order(*e[2:4]))
            while i < len(entries) and _order(*entries[i][:2]) <= high:
                e = entries[i]
                if skip >= e[7] and low <= _order(*e[:2]) and _order(*e[2:4]) <= high:
                    skip -= e[7]
                elif level:
                    yield from walk(self._block(tuple(e[4:7])), level - 1)
                else:
                    yield e
                i += 1

        for e in walk(self.root, self.levels):
            yield tuple(e[4:7])

    def get(self, key: str) -> list[dict]:
        return [parse(self.ranges.read(*where)) for where in self.find(key)]


_RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_PIECE = 1000


class _Records:
    """Gathers parsed records and lets them go by the few megabytes."""

    def __init__(self, payload: bool):
        self.payload, self.made, self.size = payload, [], 0
        self.names = [x.split()[0] for x in _RECORD.split(", ")] + ["payload"] * payload
        self.types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payload

    def add(self, member: bytes) -> Iterator[pa.RecordBatch]:
        found = parse(member)
        self.made.append(found)
        self.size += 200 + len(found["url"])
        if self.payload:
            self.size += len(found["payload"] or b"")
        else:
            found["payload"] = None
        if self.size > FLUSH_BYTES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.made:
            yield pa.RecordBatch.from_arrays([pa.array([m[n] for m in self.made], type=t) for n, t in zip(self.names, self.types, strict=True)], names=self.names)
            self.made, self.size = [], 0


def fetch_captures(index: Index, wanted: DataFrame, key_col: str = "key", id_col: str = "page_id", payload: bool = False) -> DataFrame:
    """The records of the ``wanted`` captures, found by binary search and read back from the archives by byte range, verified.

    Each row of ``wanted`` (a key as ``url_key`` makes it, null for an empty one, and an id, which
    may be null) brings one record: rows that repeat a key and id bring as many as there are, but
    none that isn't there. Look-ups are sorted as the index is, so a task reads few blocks; a key and id that very many
    rows share is looked up in pieces of ``_PIECE`` records. Other columns are left out; an empty
    table gives no rows.
    """
    names = F.coalesce(F.col(quoted(key_col)), F.lit("")).alias("key"), F.col(quoted(id_col)).cast("long").alias("page_id")
    pieces = wanted.select(*names).groupBy("key", "page_id").agg(F.count(F.lit(1)).alias("n"))
    pieces = pieces.select("key", "page_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(_PIECE).cast("long"))).alias("skip"))
    top = Index(index.root, index.levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = CaptureIndex(top), _Records(payload)
        for batch in batches:
            for key, page, n, skip in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                for where in islice(held.find(key, page, skip=skip), min(_PIECE, n - skip)):
                    yield from out.add(held.ranges.read(*where))
        yield from out.rest()

    tasks = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = pieces.repartitionByRange(tasks, "key", "page_id", "skip").sortWithinPartitions("key", "page_id", "skip")  # a fixed number: the rows are small, their reads are not
    return spread.mapInArrow(run, _RECORD + ", payload binary" * payload)


def read_archives(index: Index, payload: bool = False) -> DataFrame:
    """Every record that the index knows, block by block, read back from the archives and verified: its fields, and with ``payload`` its bytes (null for revisits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, out = _Ranges(), _Records(payload)
        for batch in batches:
            for block in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for entry in sorted(_entries(ranges, *block), key=lambda e: e[4:6]):
                    yield from out.add(ranges.read(*entry[4:7]))
        yield from out.rest()

    tasks = int(index.blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.blocks.select("file", "at", "size").repartition(tasks, "file", "at").mapInArrow(run, _RECORD + ", payload binary" * payload)
