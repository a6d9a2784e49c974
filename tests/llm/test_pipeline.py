"""The corpus pipeline: columns, nulls, decisions of each stage, and that queries live without it."""

import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline as P
from larkspur.llm import byte_bpe, mixture, quality
from larkspur.llm.queries import PATTERN, RANKS
from tests.llm.test_tables import brute_classes, corpus

ROOT = P.__file__.rsplit("/", 1)[0]


def test_stages_in_order():
    assert [name for name, _ in P.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "encode"]


def test_every_stage_on_the_small_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(out.count())
        if k < 4:
            assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            docs = out
    assert counts[0] > counts[1] == counts[2] > counts[3] and counts[4] == counts[5] > 0
    codec = byte_bpe.codec(Path(RANKS).read_bytes(), PATTERN)
    want = Counter((r["doc_id"], tuple(codec.encode(r["text"]))) for r in docs.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in out.collect()) == want
    assert P.run(spark, "/root/testdata/sf0.001").count() == counts[5]


def test_nulls_ties_clashes_and_empty_tables(spark):
    rng = random.Random(1)
    text = lambda: "\n".join(" ".join(f"t{rng.randrange(9000)}" for _ in range(12)) for _ in range(6))
    good = [text() for _ in range(30)]  # copies stand in sources of their own, or their lines would go as boilerplate
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", len(t), 1, 2, 3) for i, t in enumerate(good)]
    rows += [(None, good[0], None, None, None, 1, 2, 3), (40, None, "en", "s1", None, 1, 2, 3), (41, "", "en", "s1", 0, 1, 2, 3), (2, good[2], "en", "x1", 5, 1, 2, 3), (2, good[2], "en", "x2", 5, 1, 2, 3), (50, good[2], "en", "x3", 5, 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, shard int, _keys int")
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for k, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, now, "").cache()
            out.count()
            assert k == 4 or out.columns == docs.columns
            if not empty and k == 0:
                assert {r["doc_id"] for r in out.collect()} == {*range(30), None, 50}
            if not empty and k == 2:
                assert Counter(r["doc_id"] for r in out.collect())[2] == 3 and 50 not in {r["doc_id"] for r in out.collect()}
            now = out
        assert (now.count() == 0) == empty


def test_quality_stage_keeps_clean_documents(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").where("quality = 1")
    judged = quality.judge_quality(spark.read.parquet(f"{d}/documents.parquet")).join(labels, "doc_id").where(~F.col("base_failed"))
    assert judged.where("kept").count() >= 0.995 * judged.count()


def test_near_dedup_stage_against_brute_force(spark):
    rng = random.Random(12)
    docs = corpus(rng, 25, 5, 100) + [(-1, None), (-2, ""), (7000, "same words here"), (7001, "same  words\nhere"), (7001, "same words here"), (7002, "x " * 100_000)]
    docs += [(7003 + i, t) for i, (_, t) in enumerate(docs[:10])]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    least = brute_classes(docs)
    kept = Counter((r["doc_id"], r["text"]) for r in P.near_dedup(spark, df, "").collect())
    assert kept == Counter((i, t) for i, t in docs if least[i] == i)


def test_mix_stage_against_its_contract(spark):
    rng = random.Random(13)
    docs = [(i, "w " * rng.choice([1, 5, 60, 300]), "en", rng.choice(["a", "a", "a", "b", "c", None]), i) for i in range(1500)] + [(9000, "word " * 200_000, "en", "d", 1), (9001, None, "en", "a", 1), (9002, "", "en", "e", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    size = {i: len((t or "").split()) for i, t, *_ in docs}
    sources = sorted({d[3] for d in docs if d[3]}) + [None]
    total = {s: sum(size[d[0]] for d in docs if d[3] == s) for s in sources}
    goal = dict(zip(sources, mixture.targets([total[s] for s in sources], [(5.0, 2.0, 1.0)[k % 3] for k in range(len(sources))]), strict=True))
    rows = P.mix_sources(spark, df, "").collect()
    assert {tuple(r) for r in rows} <= set(docs) and max(Counter(r["doc_id"] for r in rows).values()) <= 3
    for s in sources:
        taken = sum(size[r["doc_id"]] for r in rows if r["source"] == s)
        assert abs(taken - goal[s]) <= max(size[d[0]] for d in docs if d[3] == s)
    assert sum(goal.values()) <= sum(total.values()) + 1e-6
    assert [tuple(r) for r in P.mix_sources(spark, df.repartition(5), "").collect()] == [tuple(r) for r in rows]


def test_the_rest_imports_without_this_subpackage(tmp_path):
    subprocess.run(["cp", "-r", f"{ROOT}/larkspur", f"{ROOT}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "larkspur/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert q and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": str(tmp_path)})
