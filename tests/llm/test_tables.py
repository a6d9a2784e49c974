"""Operators that look across rows: WARC, mixture, line dedup, exact top-k, substring and near dedup."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import components, lines, mixture, neardup, queries, substrings, topk, warc
from larkspur.llm.common import WORD
from tests.compare import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, duck, name):
    same(queries.queries()[name](spark, SF), duck, queries.oracle_sql()[name])


def test_warc_round_trip_and_lookup(spark):
    big = "é<p>" * 400
    pages = [(1, "http://a.b.org/x?y#z", big), (5, "http://a.b.org/x?y", big), (3, "https://c.org/", None), (4, None, "small"), (6, "http://a.b.org/x?y", big), (6, "http://a.b.org/x?y", big), (None, "http://q/ \r\nInjected: 1", big), (9, "http://z", "small"), (7, "http://long/" + "u" * 100_000, "x" * 999), (8, "http://w", "x" * 999), (2, "http://big", "y" * 3_000_000)]
    df = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, key string").repartition(3)
    captures = warc.write_archives(df)
    small = {"block_captures": 3, "root_rows": 2}
    index = warc.build_index(captures, **small)
    assert index.levels > 1 and len(index.root) <= 2
    wanted = df.select(warc.url_key(F.col("url")).alias("key"), F.col("page_id").alias("size"))
    found = warc.fetch_captures(index, wanted, id_col="size", payload=True).collect()
    fields = lambda rows: Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows)
    want = Counter()
    for i, _, html in pages:
        body = (html or "").encode()
        twin = html == big and i != 6
        want[(i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if twin else "response", 6 if twin else None)] += 1
    assert fields(found) == fields(warc.read_archives(index).collect()) == want
    assert {bytes(r["payload"]) for r in found if r["record_type"] == "response"} == {(h or "").encode() for _, _, h in pages}
    held = warc.CaptureIndex(index)
    assert sorted(r["page_id"] for r in held.get("org,b,a)/x?y")) == [1, 5, 6, 6] and held.get("org,b,a)/none") == []
    assert [r["page_id"] for r in held.get("org,c)/")] == [3] and [r["page_id"] for r in held.get(")")] == [4]
    assert warc.fetch_captures(index, wanted.withColumn("key", F.concat("key", F.lit("!"))), id_col="size").count() == 0
    none = warc.build_index(warc.write_archives(df.limit(0)))
    assert warc.read_archives(none).count() == warc.fetch_captures(none, wanted, id_col="size").count() == warc.fetch_captures(index, wanted.limit(0), id_col="size").count() == 0


def test_warc_lookups_read_few_blocks_and_split_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(warc, "_PIECE", 7)
    pages = [(9, "http://hot/", "h")] * 60 + [(i, "http://hot/", "h") for i in range(200)] + [(i, f"http://h{i:04d}/", "x") for i in range(1000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    index = warc.build_index(warc.write_archives(df), 16, 8)
    held = warc.CaptureIndex(index)
    assert len(list(held.find("h0500)/", 500))) == 1 and held.read_blocks <= index.levels + 1
    assert len(list(held.find("hot)/", 9))) == 61 and len(list(held.find("hot)/", 9, skip=50))) == 11 and len(list(held.find("hot)/"))) == 260
    found = warc.fetch_captures(index, df.select(warc.url_key(F.col("url")).alias("key"), "page_id"))
    assert Counter((r["page_id"], r["url"]) for r in found.collect()) == Counter(p[:2] for p in pages)


def test_mixture_targets():
    assert mixture.targets([10, 10, 10], [5, 2, 1]) == [18.75, 7.5, 3.75]
    made = mixture.targets([1, 100, 100], [5, 2, 1])
    assert made[0] == 3 and made[1] == pytest.approx(198 * 2 / 3) and sum(made) == pytest.approx(201)
    assert mixture.targets([0, 0], [1, 1]) == [0, 0] and mixture.targets([], []) == []


def test_splitting_tree_is_exact():
    quotas = [1000, 0, 17, 333]
    for shards in (1, 3, 16):
        counts = mixture.split_quotas(quotas, shards, 3)
        assert counts.sum(0).tolist() == quotas and (counts >= 0).all() and np.ptp(counts.sum(1)) <= 1
        assert (counts == mixture.split_quotas(quotas, shards, 3)).all()
    # Hypergeometric: the mean and variance over seeds of one shard's share of 333 of 1,350.
    drawn = [mixture.split_quotas(quotas, 4, seed)[2, 3] for seed in range(60)]
    assert abs(np.mean(drawn) - 333 / 4) < 3 and 4 < np.std(drawn) < 11
    assert sorted(mixture.permuted_blocks(0, [3, 0, 4], 1)) == [0] * 3 + [2] * 4 and mixture.permuted_blocks(0, [50, 50], 1) != sorted(mixture.permuted_blocks(0, [50, 50], 1))


def test_mixture_shards_hold_their_exact_quotas(spark):
    docs = spark.createDataFrame([(i, "abc"[i % 3], "w " * (i % 7 + 1)) for i in range(3000)], "doc_id long, source string, text string")
    plan = mixture.plan_mixture(docs, blocks=128, shards=6)
    of = {n: k for k, n in enumerate(plan.names)}
    place = {r[0]: r[1] for r in docs.select("doc_id", mixture._place("doc_id", 7)).collect()}
    seen = defaultdict(set)
    for r in mixture.mix(docs, plan).collect():
        k = of[r["source"]]
        block = place[r["doc_id"]] * plan.n_blocks[k] >> 31
        for p, shard in enumerate(r["copies"]):
            seen[shard].add((k, p * plan.n_blocks[k] + block))
    quotas = [p * n + e + 1 for p, n, e in zip(plan.passes, plan.n_blocks, plan.edge, strict=True)]
    counts = mixture.split_quotas(quotas, 6, 7)
    for shard in range(6):
        assert [sum(k == s for s, _ in seen[shard]) for k in range(3)] == counts[shard].tolist()
    assert sum(map(len, seen.values())) == len(set().union(*seen.values())) == sum(quotas)


def test_mixture(spark):
    rng = random.Random(1)
    docs = [(i, rng.choice(["a", "b", "c", "é", None]) if i % 3 else "hot", "w " * rng.choice([0, 1, 3, 50, 700]), "x") for i in range(900)]
    docs += [(5, "hot", "again and again", "x"), (None, "a", "no id", "x"), (None, "a", None, "x"), (901, "empty", "", "x"), (902, "long", "word " * 300_000, "x")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, copies string")
    plan = mixture.plan_mixture(df, blocks=64, shards=5)
    mixed = mixture.mix(df, plan).cache()
    assert mixed.count() == len(docs)
    sizes = defaultdict(int)
    for _, s, t, _ in docs:
        sizes[s] += len(re.findall(WORD, t or ""))
    taken, largest = defaultdict(int), defaultdict(int)
    for r in mixed.collect():
        assert r["size"] == len(re.findall(WORD, r["text"] or "")) and r["source_size"] == sizes[r["source"]] and len(r["copies"]) <= 3
        taken[r["source"]] += r["size"] * len(r["copies"])
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["target"] == plan.targets[plan.names.index(r["source"])]
    for s, t in zip(plan.names, plan.targets, strict=True):
        assert abs(taken[s] - t) <= largest[s] and t <= 3 * sizes[s] + 1e-6
    again = mixture.mix(df.repartition(7), mixture.plan_mixture(df.repartition(2), blocks=64, shards=5))
    key = lambda d: sorted(map(repr, (tuple(r) for r in d.select("doc_id", "size", "copies").collect())))
    assert key(again) == key(mixed)
    rows = mixture.write_order(mixed).collect()
    assert len(rows) == sum(len(r["copies"]) for r in mixed.collect()) and [r["shard"] for r in rows] == sorted(r["shard"] for r in rows)
    assert plan.names[-1] is None and plan.names[:-1] == sorted(plan.names[:-1])
    none = df.limit(0)
    assert mixture.mix(none, mixture.plan_mixture(none)).count() == 0


def test_line_dedup(spark):
    pages = [(i, "h1" if i % 4 else None, f"menu\nbody {i}\n\nmenu\n{'rare' if i < 8 else 'other ' + str(i)}", 5) for i in range(60)]
    pages += [(i, "h3", f"one {i}\nboth", 5) for i in (200, 201)] + [(202 + i, "h4", "\n".join([f"own {i}"] + [f"line {k}" for k in range(70)] + ["w" * 200_000]), 5) for i in range(3)]
    pages += [(100, "h1", None, 5), (101, "h1", "", 5), (102, "h2", "menu", 5), (103, "h1", "menu\nmenu", 5), (103, "h1", "menu\nmenu", 5)]
    df = spark.createDataFrame(pages, "id int, source string, text string, n_lines int")
    seen, total = defaultdict(set), Counter(p[1] for p in pages)
    for k, (_, h, t, _) in enumerate(pages):
        for line in set((t or "").split("\n")):
            if re.search(WORD, line):
                seen[(h, line)].add(k)
    bad = {key for key, at in seen.items() if len(at) >= 2 and len(at) > 0.1 * total[key[0]]}
    want = Counter()
    for i, h, t, _ in pages:
        split = (t or "").split("\n")
        kept = None if t is None else "\n".join(x for x in split if (h, x) not in bad)
        n = sum(bool(re.search(WORD, x)) for x in split)
        want[(i, h, kept, n, sum((h, x) in bad for x in split))] += 1
    found = lines.drop_boilerplate(df, counts=True)
    assert Counter(tuple(r) for r in found.select("id", "source", "text", "n_lines", "n_dropped").collect()) == want
    assert lines.drop_boilerplate(df).columns == df.columns and lines.drop_boilerplate(df.limit(0)).count() == 0
    assert not re.search("Python|ArrowEval|Pandas", lines.drop_boilerplate(df)._jdf.queryExecution().executedPlan().toString())


def brute_top(vectors, k):
    fine = [(i, [int(np.floor(64 * np.float64(x))) for x in v]) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v) and i is not None]
    out = []
    for i, q in fine:
        if i % 20 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in fine if j != i and len(v) == len(q)))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(5, 8))
    vectors = [(i, (centers[i % 5] + 0.1 * rng.normal(size=8)).round(2).tolist()) for i in range(600)]
    vectors += [(600 + i, vectors[40][1]) for i in range(40)]  # ties
    vectors += [(700, None), (720, []), (740, [1.0, None] + [0.0] * 6), (760, [float("nan")] * 8), (780, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (800, [1.0, 2.0]), (801, [3.0, -1.0]), (820, [1e12] + [0.0] * 7), (821, [-1e12, 3.0] + [1.0] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<double>, rank string")
    found = topk.exact_top_k(df, F.col("vec_id") % 20 == 0, k=7, pivots=9, block_rows=16)
    paged = topk.exact_top_k(df, F.col("vec_id") % 20 == 0, k=7, pivots=9, block_rows=4, root_rows=20, page_rows=3)
    assert sorted(tuple(r) for r in paged.collect()) == sorted(tuple(r) for r in found.collect())
    assert sorted(tuple(r) for r in found.collect()) == [(a, b, c, max(-(1 << 63), min((1 << 63) - 1, d))) for a, b, c, d in brute_top(vectors, 7)]
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_reads_few_blocks_of_clustered_vectors(spark):
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(16, 12)) * 20, 64, axis=0) + rng.normal(size=(1024, 12)) * 0.05
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    pivots = {12: topk.choose_pivots(np.floor(64 * x), 16)}
    directory = topk._write_blocks(topk._keyed(df, pivots, 64), 16)
    rows = [tuple(r) for r in directory.orderBy("dim", "cell", "low").collect()]
    searcher = topk._Searcher(rows, 0, pivots, 20)
    searcher.search(np.array([0]), np.floor(64 * x[:1]))
    assert searcher.read_blocks < len(rows) / 4
    few, levels = topk._paged(directory, 20, 2)
    assert levels == 2 and len(few) < len(rows) / 3
    small = topk._write_blocks(topk._keyed(df, pivots, 64), 1024, 5 * (12 * 8 + 8)).select("n", "size").collect()
    assert sum(r["n"] for r in small) == 1024 and max(r["n"] for r in small) == 5


def brute_repeats(docs, length):
    words = [(i, re.findall(WORD, t or "")) for i, t in docs]
    low = {}
    for i, w in words:
        for s in range(len(w) - length + 1):
            if i is not None:
                k = tuple(w[s : s + length])
                low[k] = min(low.get(k, i), i)
    out = Counter()
    for i, w in words:
        gone = set()
        for s in range(len(w) - length + 1):
            if i is not None and low[tuple(w[s : s + length])] < i:
                gone |= set(range(s, s + length))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[(i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("length", [4, 7, 50])
def test_substring_dedup_against_brute_force(spark, length):
    rng = random.Random(length)
    word = lambda: rng.choice("abcdefgh") * rng.choice([1, 1, 2])
    base = [[word() for _ in range(rng.choice([0, 1, 3, length, 3 * length, 200]))] for _ in range(25)]
    docs = []
    for i in range(70):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w) + 1) :] = rng.choice(base)[: 2 * length]
        docs.append((rng.randrange(60) if i % 10 else None, " ".join(w).replace(" ", rng.choice([" ", "\n", "\t "]))))
    docs += [(1000, None), (1001, ""), (1002, "same " * 500), (1003, "same " * 490 + "tail"), (7, docs[1][1]), (1004, docs[1][1])]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, kept string")
    found = substrings.remove_repeats(df, length)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found.collect()) == brute_repeats(docs, length)
    assert substrings.remove_repeats(df.limit(0), length).count() == 0


def shingles(text):
    w = re.findall(WORD, text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_classes(docs, similarity=0.8):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if docs[a][0] is not None and docs[b][0] is not None and sets[a] and sets[b] and both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return {i: least[root(k)] for k, (i, _) in enumerate(docs) if i is not None}


def corpus(rng, groups, copies, size):
    docs = []
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(max(2, size // 60))):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            docs.append((len(docs) * 3, " ".join(w)))
    return docs


def test_near_classes_against_brute_force(spark):
    rng = random.Random(8)
    docs = corpus(rng, 40, 6, 120) + [(-1, None), (-2, ""), (-3, " \n"), (-4, "short text"), (-5, "short  text"), (-6, "other"), (10**6, None)]
    docs += [(10**6 + 1 + i, t) for i, (_, t) in enumerate(docs[:20])] + [(None, docs[0][1]), (None, None)]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, class_id int")
    found = neardup.near_classes(df).collect()
    assert len(found) == len(docs) and sum(r["doc_id"] is None and r["class_id"] is None for r in found) == 2
    want = brute_classes(docs)
    got = {r["doc_id"]: r["class_id"] for r in found if r["doc_id"] is not None}
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)
    assert all(want[i] == want[c] for i, c in got.items())  # nothing is merged that isn't linked
    assert neardup.near_classes(df.limit(0)).count() == 0
    kept = neardup.drop_near_copies(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(got.values()) | {None}


def test_a_large_group_of_copies_is_one_class(spark):
    rng = random.Random(9)
    docs = corpus(rng, 1, 3000, 100) + [(10**6 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(80))) for i in range(300)]
    found = {r["doc_id"]: r["class_id"] for r in neardup.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    group = Counter(c for i, c in found.items() if i < 10**6)
    assert group.most_common(1)[0][1] == 3000 and all(found[i] == i for i in found if i >= 10**6)


def test_forest_recall_grows_with_the_corpus():
    for n in (10, 10**5, 10**9):
        depth, trees = neardup.forest_shape(n)
        same_prefix = (1 - neardup.differing_share(0.8)) ** depth
        assert 1 - (1 - same_prefix) ** (trees - 1) >= neardup.RECALL


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 400)] + [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(300)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert found == {x: root(x) for x in parent if x not in alone}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pieces_of_dense_buckets_meet(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, 2).astype(np.int64)
    flip = lambda k: (base ^ np.bitwise_or.reduce(np.left_shift(np.int64(1), rng.integers(0, 20, (k, 2))), axis=0)).tolist()
    rows = [(i, *flip(3), 100, 1 if i < 300 else i) for i in range(340)] + [(1000 + i, *rng.integers(0, 1 << 62, 2).tolist(), 100, 1000 + i) for i in range(50)]
    df = spark.createDataFrame(rows, "doc long, s0 long, s1 long, n int, part long")
    bits = {r[0]: (r[1], r[2], r[4]) for r in rows}
    near = lambda x, y: (bits[x][0] ^ bits[y][0]).bit_count() + (bits[x][1] ^ bits[y][1]).bit_count() <= neardup.near_bits()
    monkeypatch.setattr(neardup, "RUN", 64)
    planted = neardup._planted(df, 2, 1)
    buckets = defaultdict(list)
    for r in planted.collect():
        buckets[r["bucket"]].append(r["doc"])
    want = {(x, y) for docs in buckets.values() if len(docs) > 64 for x in docs for y in docs if x < y and bits[x][2] != bits[y][2] and near(x, y)}
    assert {tuple(r) for r in neardup._dense_pairs(planted, 0.8, []).collect()} == want and len(want) > 5000
    assert neardup._dense_pairs(neardup._planted(df.limit(20), 2, 1), 0.8, []) is None
