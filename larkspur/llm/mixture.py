"""Operator 4: mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are put in a permuted order by a seeded hash and cut into blocks of equal
hash ranges. A source's target is so many whole passes over its blocks and a rest: the rest takes
blocks in order, and within the last one the documents up to an exact boundary, so taken words are
off by half a document at most. The block quotas are exact integers; a tree splits the range of
output shards in two again and again and draws each half's counts from a multivariate
hypergeometric distribution (so many draws without replacement from an urn that holds a ball for
each block of the node), so every shard gets its exact number of blocks and every block goes to one
shard. Shards then take disjoint blocks in a permuted order of each source and are shuffled locally.
All draws are ranks of MD5 digests: reruns agree, and SQL can say the same.

What the driver holds is bounded: ``blocks`` rows of block sums in all (more only if there are more
sources), and one row a source, at most ``MAX_SOURCES``. Documents get their copies and shards in a
map over rows, without a join: only the sums of the narrow size table are shuffled.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import WORD, cut, discard, free, keep, quoted

BLOCKS, SHARDS, MAX_SOURCES, MAX_REPEATS = 16_384, 16, 100_000, 3
WEIGHTS = (5.0, 2.0, 1.0)
_SPAN = 1 << 31


def targets(sizes: list[int], weights: list[float], limit: float = MAX_REPEATS) -> list[float]:
    """Words for each source: the sum of all sizes shared by weight; none above ``limit`` times its
    size, with the excess shared again by weight among the others until none is above."""
    caps = [limit * s for s in sizes]
    out = [0.0] * len(sizes)
    left, open_ = float(sum(sizes)), list(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / total for i in open_}
        over = [i for i in open_ if share[i] > caps[i]]
        if not over:
            for i in open_:
                out[i] = share[i]
            break
        for i in over:
            out[i] = float(caps[i])
            left -= caps[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def _draw(*parts: object) -> str:
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Counts of each source's blocks in each shard (shards x sources): exact sums both ways, shard totals equal up to one.

    A node of the tree is a range of shards and the balls (source, number) that fall to it. Its left
    half gets the balls of the smallest digests, as many as its shards are to hold: draws without
    replacement, so the counts by source are multivariate hypergeometric.
    """
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    total = sum(quotas)
    balls = [(k, j) for k, q in enumerate(quotas) for j in range(q)]
    nodes = [(0, shards, balls)]
    level = 0
    while nodes:
        below = []
        for lo, hi, have in nodes:
            if hi - lo == 1:
                for k, _ in have:
                    out[lo, k] += 1
                continue
            mid = (lo + hi) // 2
            size = total * mid // shards - total * lo // shards
            have = sorted(have, key=lambda x: (_draw(seed, level, *x), x))
            below += [(lo, mid, have[:size]), (mid, hi, have[size:])]
        nodes, level = below, level + 1
    return out


def permuted_blocks(source: int, counts: list[int], seed: int) -> list[int]:
    """The shard of each block of a source (its number counts passes too): shard after shard takes its count of a permuted order."""
    order = sorted(range(sum(counts)), key=lambda i: (_draw(seed, "block", source, i), i))
    out = [0] * len(order)
    for i, shard in zip(order, (s for s, n in enumerate(counts) for _ in range(n)), strict=True):
        out[i] = shard
    return out


@dataclass
class Plan:
    """One entry a source, in code-point order (null last)."""

    names: list[str | None]
    sizes: list[int]
    targets: list[float]
    n_blocks: list[int]
    passes: list[int]
    #: Block of the partial pass in which it ends (-1: none), and the last (place, doc_id) that it takes there.
    edge: list[int]
    last: list[tuple[int, object] | None]
    #: Shard of each block instance (pass * n_blocks + block).
    shard: list[list[int]]


def _place(id_col: str, seed: int) -> Column:
    """A document's place in the permuted order of its source, from 0 to 2**31 - 1."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(quoted(id_col)).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(_SPAN - 1))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _code_points(name: str | None) -> tuple:
    return (1, ()) if name is None else (0, tuple(map(ord, name)))


def plan_mixture(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = 7, size_col: str | None = None) -> Plan:
    """The plan of the mix of ``docs``; sizes are the word counts of whole texts, or what ``size_col`` holds.

    Null sources are a source of their own, the last; null texts have no words; repeated rows count
    each; an empty table gives an empty plan. More than ``MAX_SOURCES`` sources are refused.
    """
    size = word_count(F.col(quoted(text_col))) if size_col is None else F.col(quoted(size_col))
    narrow = cut(docs.select(F.col(quoted(source_col)).cast("string").alias("source"), F.col(quoted(id_col)).alias("id"), _place(id_col, seed).alias("place"), size.alias("size")))
    rows = narrow.groupBy("source").agg(F.sum("size").alias("words")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them before mixing")
    rows.sort(key=lambda r: _code_points(r["source"]))
    names, sizes = [r["source"] for r in rows], [int(r["words"] or 0) for r in rows]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))])
    total = sum(sizes)
    n_blocks = [max(1, min(blocks, blocks * s // total)) if total else 1 for s in sizes]
    passes = [min(MAX_REPEATS, int(t // s)) if s else 0 for s, t in zip(sizes, goal, strict=True)]
    rest = [t - p * s for s, t, p in zip(sizes, goal, passes, strict=True)]
    table = _table(docs, list(zip(names, n_blocks, strict=True)), "source string, n_blocks int")
    placed = narrow.join(F.broadcast(table), narrow["source"].eqNullSafe(table["source"])).select(narrow["source"], "id", "place", "size", _block(F.col("place"), F.col("n_blocks")).alias("block"))
    sums: dict = {n: {} for n in names}
    for r in placed.groupBy("source", "block").agg(F.sum("size").alias("words")).collect():  # at most blocks + sources rows
        sums[r["source"]][r["block"]] = int(r["words"])
    edge, before = [], []
    for k, name in enumerate(names):
        at, done = -1, 0
        if rest[k] > 0 and passes[k] < MAX_REPEATS:
            for b in range(n_blocks[k]):
                if done + sums[name].get(b, 0) >= rest[k]:
                    at = b
                    break
                done += sums[name].get(b, 0)
        edge.append(at)
        before.append(done)
    last: list = [None] * len(names)
    marks = [(n, e, rest[k] - before[k]) for k, (n, e) in enumerate(zip(names, edge, strict=True)) if e >= 0]
    if marks:
        m = _table(docs, marks, "source string, block int, room double")
        inside = placed.join(F.broadcast(m), placed["source"].eqNullSafe(m["source"]) & (placed["block"] == m["block"]))
        inside = inside.groupBy(placed["source"].alias("source"), "place", "id").agg(F.sum("size").alias("size"), F.first("room").alias("room"))
        order = Window.partitionBy("source").orderBy("place", F.col("id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
        taken = inside.withColumn("upto", F.sum("size").over(order)).where(F.col("upto") - F.col("size") / 2 <= F.col("room"))
        by = {n: k for k, n in enumerate(names)}
        for r in taken.groupBy("source").agg(F.max(F.struct("place", "id")).alias("last")).collect():  # one row a source
            last[by[r["source"]]] = (r["last"]["place"], r["last"]["id"])
    quotas = [p * n + (e + 1 if e >= 0 else 0) for p, n, e in zip(passes, n_blocks, edge, strict=True)]
    discard(narrow)
    counts = split_quotas(quotas, shards, seed)
    return Plan(names, sizes, goal, n_blocks, passes, edge, last, [permuted_blocks(k, counts[:, k].tolist(), seed) for k in range(len(names))])


def _block(place: Column, n: Column) -> Column:
    return F.shiftright(place * n, 31).cast("int")


def _table(docs: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return docs.sparkSession.createDataFrame(rows, schema)


def mix(docs: DataFrame, plan: Plan, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", seed: int = 7, size_col: str | None = None) -> DataFrame:
    """``docs`` with size, source_size, target and copies (array of the shard of each copy that the mix takes).

    Each row is decided alone, by its source, its place in the permuted order and its id: rows that
    repeat an id are taken together, null ids too. Sizes count words of the whole text (null: 0);
    documents without words are taken with their block and add nothing. ``size_col``: a column that
    holds the sizes already. Input columns of these names are replaced. The plan's table has one row a source and at most ``blocks`` shard numbers
    for each pass, so it is broadcast. An empty table stays empty.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = [(plan.names[k], plan.sizes[k], plan.targets[k], plan.n_blocks[k], plan.passes[k], plan.edge[k], plan.last[k][0] if plan.last[k] else -1, plan.last[k][1] if plan.last[k] else None, plan.shard[k]) for k in range(len(plan.names))]
    names = free(docs, "_source", "_size", "_target", "_blocks", "_passes", "_edge", "_place", "_id", "_shards")
    table = _table(docs, rows, ", ".join(f"{n} {t}" for n, t in zip(names, ("string", "bigint", "double", "int", "int", "int", "bigint", kind, "array<int>"), strict=True)))
    p_source, p_size, p_target, p_blocks, p_passes, p_edge, p_place, p_id, p_shards = map(F.col, names)
    joined = docs.join(F.broadcast(table), F.col(quoted(source_col)).cast("string").eqNullSafe(p_source), "left")
    place = _place(id_col, seed)
    block = _block(place, p_blocks)
    ident = F.col(quoted(id_col))
    upto = (place < p_place) | ((place == p_place) & (ident.isNull() | F.coalesce(ident <= p_id, F.lit(False))))
    partial = (block < p_edge) | ((block == p_edge) & upto)
    picks = [F.when((p_passes > k) | ((p_passes == k) & partial), F.get(p_shards, F.lit(k) * p_blocks + block)) for k in range(MAX_REPEATS)]
    out = keep(joined, {"size": word_count(F.col(quoted(text_col))) if size_col is None else F.col(quoted(size_col)), "source_size": p_size, "target": p_target, "copies": F.array_compact(F.array(*picks))})
    return out.select(*[c for c in out.columns if c not in names])


def write_order(mixed: DataFrame, id_col: str = "doc_id", seed: int = 7) -> DataFrame:
    """The mix itself: every copy a row with its shard, rows of a shard together and shuffled by a seeded hash.

    One shuffle of the rows by (shard, hash), ranges being split however large a shard is.
    """
    names = [c for c in mixed.columns if c not in ("copies", "shard", "copy")]
    rows = mixed.select(*[F.col(quoted(c)) for c in names], F.posexplode("copies").alias("copy", "shard"))
    (order,) = free(rows, "_order")
    rows = rows.withColumn(order, F.xxhash64(F.lit(seed + 1), F.col("shard"), F.col("copy"), F.col(quoted(id_col))))
    return rows.repartitionByRange("shard", order).sortWithinPartitions("shard", order).drop(order)
