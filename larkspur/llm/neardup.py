"""Operator 6: near-dedup by SimHash and an LSH forest.

Each distinct word sequence gets a 128-bit SimHash of its five-word shingles. The forest has several
tries over randomly permuted bits, kept as sorted keys: the node of a prefix is a stretch of the
sorted rows. Two depths matter for a text in a trie:

* Descent: from a base depth, at which nodes of mean density hold about ``BUCKET`` texts, a text goes
  down to the shallowest node that holds at most ``RUN``. Texts of one such node are compared by the
  differing bits of their signatures, so in dense regions prefixes are longer.
* Climb: the depths that a text reached tell the probability that a pair at the similarity limit met
  in some trie, 1 - prod(1 - p^depth). Where that is below ``RECALL``, the text climbs to the base
  prefix again, at which (the number of tries is chosen so, with one to spare) the recall is reached. There
  nodes are whole, however large: dense ones are cut into pieces that meet in bounded tasks.

What is near enough is verified with the Jaccard similarity of the shingle sets (32-bit hashes). A
text with more than ``NEAR`` near signatures in a node passes only the nearest on, so a group of
copies gives links in proportion to its size; such texts climb too, and on the climb every near pair
of *different* components is passed on and verified: what the limit left out is made up for, except
where both are already in one class. A node that a cut between two ranges of the sorted rows parts
counts as not searched for its texts.

Exact copies (equal words) are collapsed by a map-side minimum first. Text is shuffled only for the
candidates' shingle sets, compressed; everything else is a few longs a row. Sorting by ranges splits
hot prefixes; nothing is collected but counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import cut, discard, free, map_arrow, quoted
from larkspur.llm.components import components
from larkspur.llm.substrings import _long, _row_tags, _unpacked
from larkspur.llm.words import Block, blocks, window_hashes, word_hashes

SHINGLE, SIMILARITY, BITS = 5, 0.8, 128
BUCKET, RUN, NEAR, RECALL, PAIRS = 512, 4096, 2, 0.99, 1024
#: Largest share of differing bits that is verified: over three standard deviations above the mean at the similarity limit.
_SPREAD = 3.2

_POSITION = np.arange(BITS // 8, dtype=np.int64) * 256
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int32)


def differing_share(similarity: float) -> float:
    """Expected share of differing SimHash bits of two equally large sets of this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def near_bits(similarity: float = SIMILARITY) -> int:
    p = differing_share(similarity)
    return math.floor(BITS * p + _SPREAD * math.sqrt(BITS * p * (1 - p)))


def missed(depth: int, similarity: float = SIMILARITY) -> float:
    """Logarithm of the probability that a pair at the limit parts within a prefix of this depth."""
    return math.log1p(-((1 - differing_share(similarity)) ** depth))


def forest_shape(texts: int, similarity: float = SIMILARITY, bucket: int = BUCKET, recall: float = RECALL) -> tuple[int, int]:
    """Base depth and number of tries for so many texts; at that depth the recall is reached with one trie to spare."""
    depth = max(1, math.ceil(math.log2(max(2, texts) / bucket)))
    return depth, math.ceil(math.log(1 - recall) / missed(depth, similarity)) + 1


def shingle_sets(block: Block, hashes: np.ndarray, second: np.ndarray, k: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingle hashes, and a second family's in the same order.

    A text of fewer than ``k`` words has one shingle, all its words; one without words has none.
    """
    a, b = window_hashes(hashes, k), window_hashes(second, k)
    for i in range(block.n):
        x, y = int(block.word_at[i]), int(block.word_at[i + 1])
        if y - x >= k:
            one, at = np.unique(a[x : y - k + 1], return_index=True)
            yield one, b[x : y - k + 1][at]
        elif y > x:
            yield window_hashes(hashes[x:y], y - x), window_hashes(second[x:y], y - x)
        else:
            yield hashes[:0], second[:0]


def simhash(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """16 bytes: the majority of each bit over the shingles (ties: 0)."""
    raw = np.stack([one, two], axis=1).view(np.uint8).reshape(len(one), BITS // 8)
    counts = np.bincount((raw + _POSITION).ravel(), minlength=256 * BITS // 8).reshape(BITS // 8, 256)
    return np.packbits(2 * (counts @ _BYTE_BITS).ravel() > len(one))


def _signatures(rows: DataFrame) -> DataFrame:
    """doc, h0 and h1 (128 bits of the word sequence), s0 and s1 (the SimHash), n (shingles; 0 for texts without words)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in blocks(batch.column(1)):
            words = word_hashes(block, 0), word_hashes(block, 1)
            t0, t1 = _row_tags(block, words)
            signs, n = np.zeros((block.n, 2), dtype=np.uint64), np.zeros(block.n, dtype=np.int32)
            for i, (one, two) in enumerate(shingle_sets(block, *words)):
                n[i] = len(one)
                if len(one):
                    signs[i] = simhash(one, two).view(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n), _long(t0), _long(t1), _long(signs[:, 0].copy()), _long(signs[:, 1].copy()), pa.array(n)], names=["doc", "h0", "h1", "s0", "s1", "n"])

    return map_arrow(rows, run, "doc bigint, h0 bigint, h1 bigint, s0 bigint, s1 bigint, n int")


def permuted_keys(signs: np.ndarray, trees: int, seed: int = 11) -> np.ndarray:
    """(texts, trees): 64 of the bits of each signature in a random order of the trie, as sortable longs."""
    bits = np.unpackbits(np.ascontiguousarray(signs).view(np.uint8).reshape(len(signs), BITS // 8), axis=1)
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.empty((len(signs), trees), dtype=np.int64)
    for t in range(trees):
        key = np.ascontiguousarray(np.packbits(bits[:, rng.permutation(BITS)[:64]], axis=1)).view(">u8").ravel().astype(np.uint64)
        out[:, t] = (key ^ np.uint64(1 << 63)).view(np.int64)
    return out


def near_pairs(signs: np.ndarray, sizes: np.ndarray, group: np.ndarray | None, limit: int, near: int | None, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i < j) of near signatures and possible sizes, and the texts that had more than ``near`` of them.

    ``group``: only pairs of different groups count.
    """
    left, right, over = [], [], []
    step = max(1, (1 << 20) // max(1, len(signs)))
    for begin in range(0, len(signs), step):
        end = min(begin + step, len(signs))
        differ = np.bitwise_count(signs[begin:end, None, 0] ^ signs[None, :, 0]) + np.bitwise_count(signs[begin:end, None, 1] ^ signs[None, :, 1])
        fits = differ <= limit
        if not near and not fits.any():
            continue
        fits[np.arange(end - begin), np.arange(begin, end)] = False
        i, j = np.nonzero(fits)
        fair = np.minimum(sizes[begin + i], sizes[j]) >= similarity * np.maximum(sizes[begin + i], sizes[j]) - 1e-9
        if group is not None:
            fair &= group[begin + i] != group[j]
        i, j = i[fair], j[fair]
        if near and len(i):
            counts = np.bincount(i, minlength=end - begin)
            many = np.flatnonzero(counts > near)
            if len(many):
                over.append(begin + many)
                order = np.lexsort((j, differ[i, j], i))
                i, j = i[order], j[order]
                rank = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)
                i, j = i[rank < near], j[rank < near]
        left.append(begin + i)
        right.append(j)
    none = np.zeros(0, np.int64)
    a, b = (np.concatenate(x) if x else none for x in (left, right))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1], (np.concatenate(over) if over else none)


_ROW = "doc bigint, s0 bigint, s1 bigint, n int"


def _planted(texts: DataFrame, trees: int, depth: int) -> DataFrame:
    """Each text once a trie: bucket (trie and prefix), key (its permuted bits), doc, s0, s1, n and part."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                rows = batch.slice(begin, 4096)
                keys = permuted_keys(np.stack([rows.column(k).to_numpy(zero_copy_only=False) for k in (1, 2)], axis=1), trees)
                for t in range(trees):
                    bucket = (keys[:, t] >> (64 - depth)) * 4096 + t
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(keys[:, t]), *rows.columns], names=["bucket", "key", *rows.schema.names])

    return texts.select("doc", "s0", "s1", "n", "part").mapInArrow(plant, f"bucket bigint, key bigint, {_ROW}, part bigint")


def _pairs_of(table: pa.Table, limit: int, near: int | None, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Near pairs (a < b) of the rows (any two columns, doc, s0, s1, n, part), and the texts with more than ``near`` near ones."""
    doc, s0, s1, n = (table.column(k).to_numpy() for k in (2, 3, 4, 5))
    group = None if table.column(6).null_count else table.column(6).to_numpy()
    i, j, over = near_pairs(np.stack([s0, s1], axis=1).view(np.uint64), n.astype(np.int64), group, limit, near, similarity)
    return np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j]), doc[over]


def _compared(rows: DataFrame, similarity: float) -> DataFrame:
    """All near pairs (a, b) of different parts within each stretch of rows with one value of the first column.

    ``rows``: sorted by the first column within partitions, a stretch whole in one of them and of bounded size; then any one
    column, doc, s0, s1, n and part.
    """
    limit = near_bits(similarity)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def compare() -> pa.RecordBatch:
            a, b, _ = _pairs_of(pa.Table.from_batches(held), limit, None, similarity)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            bucket = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(bucket)) + 1
            for begin, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if begin < end:
                    if held and bucket[begin] != now:
                        yield compare()
                    now = bucket[begin]
                    held.append(batch.slice(begin, end - begin))
        if held:
            yield compare()

    return rows.mapInArrow(search, "a bigint, b bigint").distinct()


def _descended(rows: DataFrame, depth: int, near: int, similarity: float, run: int) -> DataFrame:
    """Near pairs (a, b, null) of the nodes that the descent ends in, and rows (a, null, loss): what text a lost against the base depth.

    ``rows``: sorted by (bucket, key) in ranges. The rows held begin a node; when they are ``run``
    and more follow, the first key's shallowest node that ends among them is the one below the
    longest prefix that all of them share. Losses are differences of ``missed``, so their sum over
    the tries tells a text's recall; a text with more than ``near`` near ones has an infinite loss,
    one of a node that may be parted (at the edge of a range, or of equal keys beyond ``run``) the
    loss of the whole trie.
    """
    limit, base = near_bits(similarity), missed(depth, similarity)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        edge = True  # the first node of a range may have begun in the one before

        def compare(table: pa.Table, loss: float) -> pa.RecordBatch:
            a, b, over = _pairs_of(table, limit, near, similarity)
            doc = table.column(2).to_numpy()
            lost = doc if loss else doc[:0]
            other = pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(over) + len(lost), pa.int64())])
            value = pa.concat_arrays([pa.nulls(len(a), pa.float64()), pa.array(np.repeat([math.inf, loss], [len(over), len(lost)]))])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, over, lost]), pa.int64()), other, value], names=["a", "b", "loss"])

        def nodes(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            """Compares what is complete of ``table``; the rest is held."""
            nonlocal held, edge
            bucket, key = table.column(0).to_numpy(), table.column(1).to_numpy()
            at = 0
            while at < len(bucket):
                end = int(np.searchsorted(bucket, bucket[at], side="right"))
                open_ = end == len(bucket)
                loss = 0.0
                if end - at > run:
                    shared = 64 - int(key[at] ^ key[at + run]).bit_length()
                    if shared == 64:  # equal keys
                        end, loss = at + run, -base
                    else:
                        high = key[at] | np.int64((1 << (63 - shared)) - 1)
                        end, loss = at + int(np.searchsorted(key[at : at + run], high, side="right")), missed(shared + 1, similarity) - base
                elif open_ and not last:
                    break
                if edge or (open_ and end == len(bucket)):
                    loss = -base
                yield compare(table.slice(at, end - at), loss)
                edge = edge and end < len(bucket) and bucket[end] == bucket[at]
                at = end
            held = table.slice(at)

        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            now = now if held is None or not held.num_rows else pa.concat_tables([held, now]).combine_chunks()
            held = now
            if now.num_rows > run or now.column(0)[0] != now.column(0)[now.num_rows - 1]:
                yield from nodes(now, False)
        if held is not None and held.num_rows:
            yield from nodes(held, True)

    return rows.mapInArrow(search, "a bigint, b bigint, loss double").groupBy("a", "b").agg(F.sum("loss").alias("loss"))


def _dense_pairs(planted: DataFrame, similarity: float, made: list[DataFrame]) -> DataFrame | None:
    """All near pairs of different parts in buckets of more than ``RUN`` texts; None if there are none.

    A bucket is cut into pieces of about half a run: of one large part each, or of small parts
    together (by hash, so about that size). Every piece meets every piece of the bucket but those of its own large part, so a part
    that fills the bucket costs in proportion to its size, and a task sees two pieces at a time.
    """
    piece = RUN // 2
    counts = cut(planted.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("k")))
    made.append(counts)
    dense = counts.groupBy("bucket").agg(F.sum("k").alias("all")).where(F.col("all") > RUN)
    if dense.isEmpty():
        return None
    large = F.col("k") > piece
    sized = counts.join(dense, "bucket").withColumn("cuts", F.ceil(F.when(large, F.col("k")).otherwise(F.col("all")) / piece).cast("int")).withColumn("owner", F.when(large, F.col("part")))
    draw = F.when(F.col("owner").isNotNull(), F.pmod(F.xxhash64("doc"), F.col("cuts"))).otherwise(F.pmod(F.xxhash64("part"), F.col("cuts"))).cast("int")
    rows = cut(planted.join(sized.select("bucket", "part", "cuts", "owner"), ["bucket", "part"]).withColumn("piece", F.xxhash64("owner", draw)))
    made.append(rows)
    pieces = rows.select("bucket", "piece", "owner").distinct()
    biggest = counts.groupBy("bucket").agg(F.max_by("part", F.struct("k", "part")).alias("most"))
    rest = pieces.join(biggest, "bucket").where("owner is null or owner <> most").select("bucket", F.col("piece").alias("p"), F.col("owner").alias("po"))
    met = pieces.join(rest, "bucket").where("owner is null or po is null or owner <> po").select("bucket", F.least("p", "piece").alias("x"), F.greatest("p", "piece").alias("y")).distinct()
    meeting = F.xxhash64("bucket", "x", "y").alias("meeting")
    sides = met.select("bucket", meeting, F.explode(F.array_distinct(F.array("x", "y"))).alias("piece"))
    grouped = rows.join(sides, ["bucket", "piece"]).select("meeting", "key", "doc", "s0", "s1", "n", "part")
    return _compared(grouped.repartition("meeting").sortWithinPartitions("meeting"), similarity)


def _candidates(texts: DataFrame, depth: int, trees: int, near: int, similarity: float) -> DataFrame:
    """The descent: pairs (a, b, null) of near signatures, and rows (a, null, loss), one a text that lost recall.

    ``texts``: doc, s0, s1, n and part (texts of one part are not paired; null: all are).
    """
    planted = _planted(texts, trees, depth)
    # Keys begin with the prefix, so a node's rows lie together in the order of the trie; ranges split hot prefixes.
    return _descended(planted.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key"), depth, near, similarity, RUN)


def _climbs(depth: int, trees: int, similarity: float, recall: float = RECALL) -> Column:
    """Whether what a text reached leaves it below the recall."""
    return F.col("loss") > math.log(1 - recall) - trees * missed(depth, similarity) + 1e-9


def _met(planted: DataFrame, similarity: float) -> DataFrame:
    """All near pairs of different parts in buckets of at most ``RUN`` texts, each whole in one task."""
    dense = planted.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > RUN).select("bucket")
    rows = planted.join(dense, "bucket", "left_anti").repartition("bucket").sortWithinPartitions("bucket")
    return _compared(rows, similarity)


def _sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """h0 as doc, and the shingle set (sorted 32-bit hashes) of the ``wanted`` (doc, h0) texts."""
    def pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for block in blocks(batch.column(1)):
            t0, _ = _row_tags(block, (word_hashes(block, 0), word_hashes(block, 1)))
            texts = [packer.compress(block.data[a:b].tobytes()) for a, b in zip(block.offsets[:-1], block.offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n), _long(t0), pa.array(texts, pa.binary())], names=["doc", "h0", "packed"])

    def build(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, texts in _unpacked(batch.column(1)):
            for block in blocks(texts):
                words = word_hashes(block, 0), word_hashes(block, 1)
                sets = [np.unique((one >> np.uint64(32)).astype(np.uint32)).tobytes() for one, _ in shingle_sets(block, *words)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first + block.first, block.n), pa.array(sets, pa.binary())], names=["doc", "shingles"])

    packed = map_arrow(rows, pack, "doc bigint, h0 bigint, packed binary")
    chosen = packed.join(wanted, ["doc", "h0"], "left_semi").select(F.col("h0").alias("doc"), "packed")
    return map_arrow(chosen, build, "doc bigint, shingles binary").groupBy("doc").agg(F.min("shingles").alias("shingles"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float, made: list[DataFrame]) -> DataFrame:
    """The pairs whose shingle sets have at least this Jaccard similarity.

    Each pair brings b's set to a's; a's comes once and first, and the stream of its pairs is read
    on. The pairs of an a that has very many are dealt to several tasks, each with a's set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for a, slot, b, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                shingles = np.frombuffer(raw.as_buffer(), dtype=np.uint32) if raw.is_valid else np.zeros(0, np.uint32)
                if b is None:
                    now, own = (a, slot), shingles.copy()
                elif (a, slot) == now and len(own) and len(shingles):
                    both = len(np.intersect1d(own, shingles, assume_unique=True))
                    if both >= similarity * (len(own) + len(shingles) - both) - 1e-9:
                        out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    slots = cut(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("slots")))
    made.append(slots)
    heads = slots.join(sets, F.col("a") == F.col("doc")).select("a", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.lit(None).cast("bigint").alias("b"), "shingles")
    dealt = pairs.join(slots, "a").select("a", F.pmod(F.xxhash64("b"), F.col("slots")).cast("int").alias("slot"), "b")
    rows = dealt.join(sets, F.col("b") == F.col("doc")).select("a", "slot", "b", "shingles").unionByName(heads)
    return rows.repartition("a", "slot").sortWithinPartitions("a", "slot", F.col("b").asc_nulls_first()).mapInArrow(run, "a bigint, b bigint")


def _shared(narrow: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Links (a, b) from the documents with several texts to the smallest id of each; None if there are none."""
    several = cut(narrow.where("doc is not null and n > 0").groupBy("doc").agg(F.min(F.struct("h0", "h1")).alias("x"), F.max(F.struct("h0", "h1")).alias("y")).where("x <> y").select("doc"))
    if several.isEmpty():
        return None
    own = narrow.where("n > 0").join(several, "doc").select("doc", "h0", "h1")
    return cut(own.join(texts.select("h0", "h1", F.col("doc").alias("first")), ["h0", "h1"]).where("first <> doc").select(F.col("first").alias("a"), F.col("doc").alias("b")).distinct())


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``id_col`` and class_id, the smallest id of its class.

    Classes are the connected components of texts whose sets of five-word shingles have a Jaccard
    similarity of at least ``similarity`` (shorter texts are one shingle), as far as the forest
    finds them; texts of equal words are always in one class. Null, empty and blank texts are
    classes of their own, each row; a null id has a null class. Rows that share an id are one
    document with the links of all its texts; texts are told apart by 64 bits of hash while they
    are compared. Ids are integers; ``id_col`` may not be named class_id. Other columns are left out; an empty table gives no rows.
    """
    if id_col.lower() == "class_id":
        raise ValueError("the id column can't be named class_id")
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc"), F.col(quoted(text_col)).alias("text"))
    narrow = cut(_signatures(rows))
    worded = narrow.where("doc is not null and n > 0")
    texts = cut(worded.groupBy("h0", "h1").agg(F.min(F.struct("doc", "s0", "s1", "n")).alias("x"), F.count(F.lit(1)).alias("copies")).select("h0", "h1", "x.*", "copies"))
    depth, trees = forest_shape(texts.count(), similarity)
    # Texts, not documents, are compared: a document may have several. Only links are of documents.
    signed = texts.select(F.col("h0").alias("doc"), "s0", "s1", "n", F.col("doc").alias("first"))
    found = cut(_candidates(signed.withColumn("part", F.lit(None).cast("bigint")), depth, trees, NEAR, similarity))
    pairs, climbing = found.where("b is not null").select("a", "b"), found.where("b is null").where(_climbs(depth, trees, similarity)).select(F.col("a").alias("doc"))
    wanted = pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).union(climbing).distinct()
    sets = cut(_sets(rows.where("doc is not null"), texts.join(wanted.withColumnRenamed("doc", "h0"), "h0", "left_semi").select("doc", "h0")))
    firsts = signed.select("doc", "first")
    made = [found, sets]

    def linked(near: DataFrame) -> DataFrame:
        a = near.join(firsts.toDF("a", "x"), "a").join(firsts.toDF("b", "y"), "b")
        return a.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    links, shared = cut(linked(_verified(pairs, sets, similarity, made))), _shared(narrow, texts)
    made += [links, shared]
    links = links if shared is None else links.unionByName(shared)
    roots = components(links)
    if not climbing.isEmpty():
        again = signed.join(climbing, "doc", "left_semi").join(roots.withColumnRenamed("node", "first"), "first", "left").withColumn("part", F.coalesce("root", "first"))
        again = cut(again.select("doc", "s0", "s1", "n", "part"))
        planted = cut(_planted(again, trees, depth))
        made += [again, planted]
        more, dense = _met(planted, similarity), _dense_pairs(planted, similarity, made)
        more = cut((more if dense is None else more.union(dense).distinct()).join(pairs, ["a", "b"], "left_anti"))
        added = cut(linked(_verified(more, sets, similarity, made)))
        made += [more, added, roots]
        roots = components(links.unionByName(added))
    discard(*made)
    # Copies of one word sequence take the class of the smallest id among them.
    # Only the documents' side can be skewed, and adaptive execution splits it.
    repeated = texts.where("copies > 1").select("h0", "h1", F.col("doc").alias("first"))
    known = narrow.select("doc", "h0", "h1", "n").join(repeated, ["h0", "h1"], "left")
    named = known.select("doc", F.when(F.col("n") > 0, F.coalesce("first", "doc")).otherwise(F.col("doc")).alias("first"), (F.col("n") > 0).alias("worded"))
    joined = named.join(roots, F.col("first") == F.col("node"), "left")
    return joined.select(F.col("doc").alias(id_col), F.when(F.col("doc").isNull(), None).when(F.col("worded"), F.coalesce("root", "first")).otherwise(F.col("doc")).alias("class_id"))


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document of each class: that with the smallest id. Rows with a null id stay."""
    (name,) = free(docs, "_gone")
    gone = cut(near_classes(docs, similarity, id_col, text_col).where(F.col("class_id") < F.col(quoted(id_col))).select(F.col(quoted(id_col)).cast("long").alias(name)).distinct())
    return docs.join(gone, F.col(quoted(id_col)).cast("long") == F.col(name), "left_anti")
