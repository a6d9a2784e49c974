"""Operator 9: exact top-k inner products with a pivot-distance index.

Vectors become integers, are keyed by their nearest pivot and their distance to it, and are written
in key order as blocks: annuli of a pivot's cell. A directory row tells each block's cell, smallest
and largest distance and largest norm. A query expands blocks by falling upper bound of their scores
(from the triangle inequality for the distance between query and block) and stops at the first bound
below its k-th best score, so results are exact whatever the pivots are; these are fitted on a
bounded sample, but every vector is indexed.

A block holds at most ``BLOCK_ROWS`` vectors and ``BLOCK_BYTES`` bytes (one vector at least). The
directory is an entry a block; where it has more than ``ROOT_ROWS`` entries, they are written in
pages of one cell each, with a directory of their own, and so on: what is broadcast is bounded
whatever the data. Queries are sorted like the index and go through in chunks; a task holds one
chunk and a few pages and blocks, which it reads from the shared folder by byte range.
"""

from __future__ import annotations

import json
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import cut, discard, quoted, shared_folder
from larkspur.llm.warc import _Appender, _Ranges

SCALE, PIVOTS, PIVOT_SAMPLE, BLOCK_ROWS, BLOCK_BYTES, ROOT_ROWS, PAGE_ROWS = 64, 64, 4096, 1024, 1 << 22, 16_384, 1024
#: Floats hold integers exactly up to here; larger products are summed with Python's integers.
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def quantised(column: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and float64 matrices of floor(scale * x), one pair for each vector length.

    Vectors that are null, empty or hold a null or non-finite component are left out.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for dim in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == dim)
        x = flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(scale * x)
        fine = np.isfinite(x).all(axis=1)
        if fine.any():
            yield rows[fine], x[fine]


def choose_pivots(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Farthest-point start and a few rounds of k-means on the sample."""
    sample = np.unique(sample, axis=0)
    chosen = [int(np.argmin(((sample - sample.mean(0)) ** 2).sum(1)))]
    near = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    pivots = sample[chosen].copy()
    for _ in range(rounds):
        owner = np.argmin(_squares(sample, pivots), axis=1)
        for k in range(len(pivots)):
            if (owner == k).any():
                pivots[k] = sample[owner == k].mean(0)
    return pivots


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances; from differences where products could overflow or cancel badly, so in blocks of b."""
    out = np.empty((len(a), len(b)))
    for k in range(len(b)):
        out[:, k] = ((a - b[k]) ** 2).sum(1)
    return out


_KEYED = "vec_id bigint, dim int, cell int, distance double, vector binary"


def _keyed(vectors: DataFrame, pivots: dict[int, np.ndarray], scale: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 2048):
                part = batch.slice(begin, 2048)
                for rows, x in quantised(part.column(1), scale):
                    dim = x.shape[1]
                    d = np.sqrt(_squares(x, pivots.get(dim, np.zeros((1, dim)))))
                    cell = np.argmin(d, axis=1)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(rows)), cell]), pa.array([v.tobytes() for v in x], pa.binary())], names=["vec_id", "dim", "cell", "distance", "vector"])

    return vectors.mapInArrow(run, _KEYED)


_DIRECTORY = "dim int, cell int, low double, high double, norm double, largest double, n bigint, file string, at bigint, size bigint"


def _write_blocks(keyed: DataFrame, block_rows: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    folder = shared_folder(keyed.sparkSession) + "/vectors"
    order = ["dim", "cell", "distance", "vec_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, waiting = None, None, []

        def flush() -> pa.RecordBatch:
            nonlocal out
            out = out or _Appender(folder, ".blk")
            ids = np.array([w[0] for w in waiting], dtype=np.int64)
            x = np.frombuffer(b"".join(w[2] for w in waiting), dtype=np.float64).reshape(len(waiting), -1)
            data = ids.tobytes() + x.tobytes()
            row = [key[0], key[1], waiting[0][1], waiting[-1][1], float((x**2).sum(1).max()), float(np.abs(x).max()), len(waiting), out.url, out.add(data), len(data)]
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES, strict=True)], names=_NAMES)

        for batch in batches:
            for vec, dim, cell, distance, raw in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if waiting and (key != (dim, cell) or len(waiting) >= block_rows or (len(waiting) + 1) * (len(raw) + 8) > block_bytes):
                    yield flush()
                key = (dim, cell)
                waiting.append((vec, distance, raw))
        if waiting:
            yield flush()
        if out is not None:
            out.stream.close()

    return cut(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _DIRECTORY))


_NAMES = [x.split()[0] for x in _DIRECTORY.split(", ")]
_TYPES = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def _paged(directory: DataFrame, root_rows: int, page_rows: int) -> tuple[list[tuple], int]:
    """At most ``root_rows`` entries (or one for each cell and length, if these are more) and the number of levels of pages below them."""
    folder = shared_folder(directory.sparkSession) + "/pages"
    order = ["dim", "cell", "low", "file", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, waiting = None, []

        def flush() -> pa.RecordBatch:
            nonlocal out
            out = out or _Appender(folder, ".dir.z")
            data = zlib.compress(json.dumps(waiting).encode(), 1)
            low, high, norm, largest, n = min(r[2] for r in waiting), *(max(r[i] for r in waiting) for i in (3, 4, 5)), sum(r[6] for r in waiting)
            row = [*waiting[0][:2], low, high, norm, largest, n, out.url, out.add(data), len(data)]
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES, strict=True)], names=_NAMES)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if waiting and (waiting[0][:2] != row[:2] or len(waiting) >= page_rows):
                    yield flush()
                waiting.append(row)
        if waiting:
            yield flush()
        if out is not None:
            out.stream.close()

    levels, count = 0, directory.count()
    while count > root_rows:
        above = cut(directory.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _DIRECTORY))
        fewer = above.count()
        if fewer == count:
            break
        directory, levels, count = above, levels + 1, fewer
    return [tuple(r) for r in directory.orderBy(*order).collect()], levels


class _Entries:
    """Entries of a directory of one vector length, as arrays."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows
        self.cell = np.array([r[1] for r in rows])
        self.low, self.high, self.norm, self.largest = (np.array([r[i] for r in rows], dtype=np.float64) for i in (2, 3, 4, 5))


class _Searcher:
    """Searches chunks of queries of one length in the blocks below a directory."""

    def __init__(self, rows: list[tuple], levels: int, pivots: dict[int, np.ndarray], k: int):
        self.k, self.levels, self.pivots, self.ranges = k, levels, pivots, _Ranges()
        self.by_dim = {dim: _Entries([r for r in rows if r[0] == dim]) for dim in {r[0] for r in rows}}
        self.cache: OrderedDict = OrderedDict()
        self.pages: OrderedDict = OrderedDict()
        self.read_blocks = 0

    def block(self, row: tuple) -> tuple[np.ndarray, np.ndarray]:
        dim, n, *where = row[0], *row[6:]
        key = tuple(where)
        if key in self.cache:
            self.cache.move_to_end(key)
            return self.cache[key]
        data = self.ranges.read(*where)
        found = np.frombuffer(data, np.int64, n), np.frombuffer(data, np.float64, n * dim, 8 * n).reshape(n, dim)
        self.cache[key] = found
        self.read_blocks += 1
        while len(self.cache) > 1 and sum(x.nbytes for _, x in self.cache.values()) > 1 << 26:
            self.cache.popitem(last=False)
        return found

    def page(self, row: tuple) -> _Entries:
        key = row[7:]
        if key not in self.pages:
            self.pages[key] = _Entries([tuple(r) for r in json.loads(zlib.decompress(self.ranges.read(*key)))])
            while len(self.pages) > 16:
                self.pages.popitem(last=False)
        self.pages.move_to_end(key)
        return self.pages[key]

    def chunk(self, dim: int) -> int:
        return int(np.clip((1 << 21) // max(1, len(self.by_dim[dim].rows)), 16, 256))

    def search(self, ids: np.ndarray, q: np.ndarray) -> list[tuple[np.ndarray, list[int]]]:
        """For each query the vec_ids and scores of its k best."""
        dim = q.shape[1]
        best = [(np.zeros(0, np.int64), np.zeros(0, object)) for _ in ids]
        if dim in self.by_dim:
            far = np.sqrt(_squares(q, self.pivots.get(dim, np.zeros((1, dim)))))
            self._expand(self.by_dim[dim], self.levels, ids, q, far, best, np.full(len(ids), -np.inf))
        return [(a, list(s)) for a, s in best]

    def _expand(self, d: _Entries, level: int, ids: np.ndarray, q: np.ndarray, far: np.ndarray, best: list, limit: np.ndarray) -> None:
        """Takes the entries by falling bound until none can still matter; pages are expanded in their turn."""
        dim = q.shape[1]
        gap = np.maximum(0, np.maximum(far[:, d.cell] - d.high, d.low - far[:, d.cell]))
        squares = (q**2).sum(1)[:, None]
        bounds = (squares + d.norm - gap**2) / 2
        bounds = np.where(np.isnan(bounds), np.inf, bounds + 1e-9 * (squares + d.norm) + 1e-6)
        top = bounds.max(axis=0)
        for b in np.argsort(-top, kind="stable"):
            if top[b] < limit.min():
                break
            need = np.flatnonzero(bounds[:, b] >= limit)
            if not len(need):
                continue
            if level:
                inner = limit[need]
                chosen = [best[i] for i in need]
                self._expand(self.page(d.rows[b]), level - 1, ids[need], q[need], far[need], chosen, inner)
                limit[need] = inner
                for i, found in zip(need, chosen, strict=True):
                    best[i] = found
                continue
            vec, x = self.block(d.rows[b])
            largest = np.abs(q[need]).max() * d.largest[b] * dim
            if largest < _EXACT:
                scores = q[need] @ x.T
            else:
                scores = np.array([[max(-_LONG - 1, min(_LONG, s)) for s in row] for row in (np.array([[int(v) for v in r] for r in q[need]], object) @ np.array([[int(v) for v in r] for r in x], object).T)], object)
            for i, row in zip(need, scores, strict=True):
                at = np.flatnonzero((row >= limit[i]) & (vec != ids[i]))
                if len(at) > 4 * self.k and scores.dtype != object:
                    least = np.partition(row[at], len(at) - self.k)[len(at) - self.k]
                    at = at[row[at] >= least]
                if not len(at):
                    continue
                all_ids = np.concatenate([best[i][0], vec[at]])
                all_scores = np.concatenate([best[i][1], np.array([int(s) for s in row[at]], object)])
                order = sorted(range(len(all_ids)), key=lambda j: (-all_scores[j], all_ids[j]))[: self.k]
                best[i] = all_ids[order], all_scores[order]
                if len(order) == self.k:
                    limit[i] = float(all_scores[order[-1]])
                    if abs(limit[i]) >= _EXACT:
                        limit[i] = np.nextafter(limit[i], -np.inf)


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, root_rows: int = ROOT_ROWS, page_rows: int = PAGE_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best scores of each row for which ``is_query`` holds.

    Components become floor(scale * x); the score is the integer inner product with every other row
    of the same length; ties go to the smaller vec_id; fewer than k candidates give all of them.
    Vectors that are null, empty or hold a null, infinite or NaN component take no part, neither do
    rows with a null id. Rows that share a query's id are not its candidates; repeated query rows
    are answered once each. Scores outside 64 bits are clamped. Other columns are left out; an
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), F.col(quoted(vector_col)).alias("vector"), is_query.alias("is_query")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("vector").toArrow()
    found: dict[int, np.ndarray] = {x.shape[1]: choose_pivots(x, pivots) for _, x in quantised(sample.column(0), scale)} if sample.num_rows else {}
    keyed = cut(_keyed(rows.select("vec_id", "vector"), found, scale))
    total = keyed.count()
    directory = _write_blocks(keyed, block_rows)
    root, levels = _paged(directory, root_rows, page_rows)
    discard(keyed, directory)
    shared = spark.sparkContext.broadcast((root, levels, found, k))  # bounded by root_rows
    asked = _keyed(rows.where("is_query").select("vec_id", "vector"), found, scale)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 1_000_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher, waiting = None, []

        def answer() -> pa.RecordBatch:
            ids = np.array([w[0] for w in waiting], np.int64)
            q = np.frombuffer(b"".join(w[2] for w in waiting), np.float64).reshape(len(waiting), -1)
            waiting.clear()
            out: tuple[list, list, list, list] = ([], [], [], [])
            for query, (vec, score) in zip(ids, searcher.search(ids, q), strict=True):
                out[0].extend([query] * len(vec))
                out[1].extend(range(1, len(vec) + 1))
                out[2].extend(vec)
                out[3].extend(score)
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            searcher = searcher or _Searcher(*shared.value)
            for vec, dim, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if waiting and (waiting[0][1] != dim or len(waiting) >= searcher.chunk(dim)):
                    yield answer()
                waiting.append((vec, dim, raw))
        if waiting:
            yield answer()

    order = ["dim", "cell", "distance", "vec_id"]
    return asked.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(run, "query_id bigint, rank int, vec_id bigint, score bigint")
