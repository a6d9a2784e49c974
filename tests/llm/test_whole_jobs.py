"""The operators do their whole job, also where a part of it used to be left out."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import chat, neardup
from larkspur.llm.queries import op5_chat


def test_chat_figures_are_read_from_the_expanded_examples(spark, monkeypatch):
    SF = "/root/testdata/sf0.001"
    before = {r["conv_id"]: r for r in op5_chat(spark, SF).collect()}
    expand = chat.expand_examples
    monkeypatch.setattr(chat, "expand_examples", lambda rendered: expand(rendered).withColumn("formatted", F.concat("formatted", F.lit("!"))))
    n = {r["conv_id"]: r["count"] for r in spark.read.parquet(f"{SF}/conversations.parquet").where("role = 'assistant'").groupBy("conv_id").count().collect()} | {-7: 1}
    assert {c: r["formatted_chars"] for c, r in before.items() if c in n} == {r["conv_id"]: r["formatted_chars"] - n[r["conv_id"]] for r in op5_chat(spark, SF).collect() if r["conv_id"] in n}


def test_whole_examples_and_the_rendering_say_the_same(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "## ### b"), (2, 1, "assistant", "c\\</turn>"), (2, 2, "assistant", None), (None, 0, "assistant", "é")]
    rendered = chat.render_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(map(repr, chat.read_whole(rendered).collect())) == sorted(map(repr, chat.read_back(rendered).collect()))


def signs(rng, n):
    rows = [(i, *(rng.integers(0, 1 << 20, 2)).tolist(), 100, i) for i in range(n)]
    return rows, lambda x, y: sum((rows[x][k] ^ rows[y][k]).bit_count() for k in (1, 2)) <= neardup.near_bits()


def test_no_pair_is_lost_where_ranges_cut_a_node(spark):
    rows, near = signs(np.random.default_rng(4), 60)
    df = spark.createDataFrame(rows, "doc long, s0 long, s1 long, n int, part long")
    buckets = defaultdict(list)
    for r in neardup._planted(df, 2, 1).collect():
        buckets[r["bucket"]].append(r["doc"])
    want = {(x, y) for docs in buckets.values() for x in docs for y in docs if x < y and near(x, y)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = neardup._candidates(df, 1, 2, None, 0.8).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    lost = want - {(r["a"], r["b"]) for r in found}
    climbing = {r["a"] for r in found if r["b"] is None and r["loss"] > 0}
    assert len(lost) > 100 and {x for pair in lost for x in pair} <= climbing
    assert {tuple(r) for r in neardup._met(neardup._planted(df, 2, 1), 0.8).collect()} == want


@pytest.mark.parametrize("batch", [7, 10_000])
def test_descent_ends_in_the_shallowest_node_that_fits(spark, batch):
    rng = np.random.default_rng(7)
    rows = [(i, int(rng.integers(-(1 << 63), 1 << 63)) if i % 3 else 5, int(rng.integers(0, 4)), 100, i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc long, s0 long, s1 long, n int, part long")
    run, depth, trees = 16, 2, 3
    planted = neardup._planted(df, trees, depth).repartition(1).sortWithinPartitions("bucket", "key")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        found = neardup._descended(planted, depth, 10**6, 0.8, run).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    keys = defaultdict(list)
    for r in planted.collect():
        keys[r["bucket"]].append((r["key"] % (1 << 64), r["doc"]))
    edges, base = {min(keys), max(keys)}, neardup.missed(depth)
    pairs, loss, near = set(), defaultdict(float), lambda x, y: (int(rows[x][1] ^ rows[y][1]) % (1 << 64)).bit_count() + (rows[x][2] ^ rows[y][2]).bit_count() <= neardup.near_bits()
    for bucket, own in keys.items():
        nodes, todo = [], [(depth, own)]
        while todo:
            d, texts = todo.pop()
            if len(texts) <= run or d == 64:
                nodes.append((d, texts))
            else:
                todo += [(d + 1, part) for bit in (0, 1) if (part := [t for t in texts if t[0] >> (63 - d) & 1 == bit])]
        for d, texts in nodes:
            docs = [x for _, x in texts]
            if len(texts) <= run:  # more are equal keys, cut somewhere
                pairs |= {(x, y) for x in docs for y in docs if x < y and near(x, y)}
            if bucket not in edges:
                for x in docs:
                    loss[x] += -base if len(texts) > run else neardup.missed(d) - base
    assert pairs <= {(r["a"], r["b"]) for r in found if r["b"] is not None}
    got = {r["a"]: r["loss"] for r in found if r["b"] is None}
    in_edges = {x for b in edges for _, x in keys[b]}
    assert all(got.get(x, 0) == pytest.approx(v) for x, v in loss.items() if x not in in_edges) and all(got[x] > 0 for x in in_edges)


def test_climb_is_decided_by_recall(spark):
    depth, trees = 5, neardup.forest_shape(512 * 32)[1]
    base = neardup.missed(depth)
    rows = [(1, -base), (2, -2 * base), (3, float("inf")), (4, 0.1 * -base)]
    climbing = {r["a"] for r in spark.createDataFrame(rows, "a long, loss double").where(neardup._climbs(depth, trees, 0.8)).collect()}
    assert climbing in ({2, 3}, {1, 2, 3}) and (trees - 1) * base <= np.log(0.01)


def test_hot_keys_are_split(spark, tmp_path):
    """One key holds nine tenths of the rows: the plans that ran split it."""
    from larkspur.llm import components, substrings
    from larkspur.session import cut

    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        hot = F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1)
        rows = cut(spark.range(400_000).repartition(8).select(hot.alias("u"), (F.col("id") + F.lit(10**9)).alias("v")))
        keyed = rows.select(F.col("u").alias("key"), F.lit(0).cast("long").alias("check"), F.col("v").alias("doc"))
        for df in (components._with_least(rows, []), substrings._repeated(keyed, ["key", "check"])[0]):
            df.collect()
            assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_document_has_the_links_of_all_its_texts(spark):
    rng = random.Random(3)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(120)]
    docs, groups = [], []
    for k in range(12):
        one, two, three = text(), text(), text()
        i = 100 * k
        # The document i has the texts one and two; i + 3 and i + 5 share the text three, and i + 5 has a second one, near to that of i + 6.
        docs += [(i, " ".join(one)), (i, " ".join(two)), (i + 1, " ".join([*one[:-1], "x"])), (i + 2, " ".join([*two[:-1], "y"]))]
        four = text()
        docs += [(i + 3, " ".join(three)), (i + 5, " ".join(three)), (i + 5, " ".join(four)), (i + 6, " ".join([*four[:-1], "z"]))]
        groups += [{i, i + 1, i + 2}, {i + 3, i + 5, i + 6}]
    found = neardup.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(found) == len(docs)
    assert {(r["doc_id"], r["class_id"]) for r in found} == {(i, min(g)) for g in groups for i in g}
