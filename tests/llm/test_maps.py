"""Operators that judge rows alone: URL filter, quality rules, byte BPE, chat formatting; and the word core."""

import hashlib
import os
import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import byte_bpe, chat, quality, urls, words
from larkspur.llm.queries import PATTERN, RANKS, op5_chat
from tests.compare import same
from tests.conftest import ROOT

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", " \n\t", "word", "a b\u00a0c é日本", "x " * 30, "one two three " * 200, "\n\nline\nline\n", "é" * 5000, "ab" * 200_000 + " end", "\u2028 \x1c \x85 z", None]


def test_words_and_hashes_are_those_of_the_regex():
    texts = pa.array(ODD)
    n, seen = 0, {}
    for limit in (1 << 20, 64):
        for block in words.blocks(texts, limit):
            h = words.word_hashes(block)
            for i in range(block.n):
                found = WORD.findall(ODD[block.first + i] or "")
                a, z = block.word_at[i], block.word_at[i + 1]
                assert [block.data[s:e].tobytes().decode() for s, e in zip(block.starts[a:z], block.ends[a:z], strict=True)] == found
                for w, x in zip(found, h[a:z], strict=True):
                    assert seen.setdefault(w, x) == x
                n += len(found)
    assert len(set(seen.values())) == len(seen) and n > 1000


def test_window_hashes_across_segments(monkeypatch):
    h = words.mix(np.arange(1000, dtype=np.uint64) % np.uint64(7))
    whole = words.window_hashes(h, 5)
    monkeypatch.setattr(words, "SEGMENT", 64)
    assert (words.window_hashes(h, 5) == whole).all()
    assert len(set(whole.tolist())) == 7 and len(words.window_hashes(h[:4], 5)) == 0


URLS = [(1, "https://WWW.Casino-Win.example.net/en/1?q#x"), (2, "http://a.example.net/fr/"), (3, "http://x.org/fr/a"), (4, "http://example.com/de/"), (5, None), (6, "no scheme"), (7, "http://net"), (8, "http://notnet/"), (9, "http://x.com/" + "a" * 300_000), (10, "http://É.example.net/en/b"), (10, "http://É.example.net/en/b"), (None, "a://b://c")]


def test_url_filter(spark):
    model = urls.default_model()
    df = spark.createDataFrame([(*r, "mine") for r in URLS], "page_id int, url string, HOST string")
    found = urls.filter_urls(df, model).collect()
    assert len(found) == len(URLS)
    for row in found:
        url = row["url"] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = sorted((r for r in urls.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])), key=lambda r: len(r[0] + r[1]))
        want = fits[-1][2] if fits else ("block" if model.score(host, path) > 0 else "allow")
        assert (row["host"], row["path"], row["rule"], row["verdict"], row["score"]) == (host, path, fits[-1][0] + fits[-1][1] if fits else None, want, model.score(host, path))
    assert urls.filter_urls(df.limit(0), model).count() == 0


def test_url_filter_is_native(spark):
    df = spark.createDataFrame([(1, "http://a/b")], "page_id int, url string")
    assert not re.search("Python|Arrow|Pandas", urls.filter_urls(df, urls.default_model())._jdf.queryExecution().executedPlan().toString())


def test_url_model_on_held_out_urls():
    model, test = urls.default_model(), urls.labelled_urls(Path(__file__).with_name("held_out_urls.tsv"))
    assert not {r[:2] for r in test} & {r[:2] for r in urls.labelled_urls()}
    assert np.mean([(model.score(h, p) > 0) == bool(y) for h, p, y in test]) > 0.9


def test_url_model_is_the_same_in_any_process():
    code = "from larkspur.llm.urls import default_model as m; print(hash((m().weights, m().bias)))"
    out = {subprocess.run([sys.executable, "-c", code], env=os.environ | {"OPENBLAS_NUM_THREADS": n, "OMP_NUM_THREADS": n, "OPENBLAS_CORETYPE": core, "PYTHONPATH": ROOT}, capture_output=True, text=True, check=True).stdout for n, core in (("1", ""), ("2", ""), ("1", "Nehalem"))}
    assert len(out) == 1 and out == {f"{hash((urls.default_model().weights, urls.default_model().bias))}\n"}


def test_many_rules_are_joined(spark, monkeypatch):
    df = spark.createDataFrame([*URLS, (11, "http://a..net/x"), (12, "http://b.c.example.org/en/1")], "page_id int, url string")
    rules = [*urls.RULES, ("example.org", "/en", "block"), (".net", "/x", "allow")]
    few = sorted(map(repr, urls.filter_urls(df, urls.default_model(), rules).collect()))
    monkeypatch.setattr(urls, "PLAN_RULES", 1)
    assert sorted(map(repr, urls.filter_urls(df, urls.default_model(), rules).collect())) == few and urls.filter_urls(df.limit(0), urls.default_model(), rules).count() == 0


def brute_quality(text):
    text = text or ""
    found = WORD.findall(text)
    seen, twice = {}, set()
    for i in range(len(found) - 7):
        seen.setdefault(tuple(found[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            twice |= {j for i in at for j in range(i, i + 8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    n = len(found)
    return n, sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), dup, len(twice), n < 20 or 100 * len(twice) > 30 * n


def brute_coverage(text, n):
    found = WORD.findall(text or "")
    at = {}
    for i in range(len(found) - n + 1):
        at.setdefault(tuple(found[i : i + n]), []).append(i)
    twice = {j for x in at.values() if len(x) > 1 for i in x for j in range(i, i + n)}
    return sum(len(found[j]) for j in twice) / max(1, sum(map(len, found)))


def brute_line_share(text):
    worded = [x for x in (text or "").split("\n") if WORD.search(x)]
    first, again = set(), 0
    for x in worded:
        again += len(x) * (x in first)
        first.add(x)
    return again / max(1, sum(map(len, worded)))


def test_quality_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + list(enumerate(ODD, -20))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    found = {r["doc_id"]: r for r in quality.judge_quality(df).collect()}
    assert len(found) == len(docs)
    for i, text in docs:
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_quality(text), i
        limits = quality.Rules()
        measured = {n: brute_coverage(text, n) for n in limits.coverage}
        assert {n: r[f"coverage_{n}"] for n in measured} == pytest.approx(measured) and r["dup_line_share"] == pytest.approx(brute_line_share(text))
        fine = all(measured[n] <= x for n, x in limits.coverage.items()) and brute_line_share(text) <= limits.duplicate_lines and r["n_symbols"] <= limits.symbols * r["n_words"]
        assert r["kept"] == (fine and not r["base_failed"])
    kept = quality.keep_quality(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs if found[i]["kept"]}
    assert quality.judge_quality(df.limit(0)).count() == quality.keep_quality(df.limit(0)).count() == 0


def test_quality_rejects_each_kind_of_repetition():
    def verdict(text):
        return next(bool(quality.measure(b, quality.Rules())["kept"][0]) for b in words.blocks(pa.array([text])))

    rng = random.Random(3)
    clean = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(300))
    assert verdict(clean) and verdict("\n".join(clean[i : i + 70] for i in range(0, len(clean), 70)))
    assert not verdict(clean[:200] + "\n" + "the same line again here\n" * 60)
    assert not verdict("five words that come again " * 50) and not verdict(clean.replace(" ", " ### ")) and not verdict("short")


def test_safe_parts_change_no_token():
    codec = byte_bpe.codec(Path(RANKS).read_bytes(), PATTERN)
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice(["a", "Z", "7", "42", " ", "  ", "\n", "\t", "'s", "'", "'t9", "!", "é", "日", "²", "\u00a0", "\u2003", "\x1c", "👍🏽", "don't", "\r\n"]) for _ in range(rng.randrange(400)))
        for size in (1, 3, 17, 100):
            parts = list(byte_bpe.safe_parts(text, size))
            assert "".join(parts) == text
            assert [i for p in parts for i in codec.encoding.encode_ordinary(p)] == codec.encoding.encode_ordinary(text)


def test_byte_bpe(spark):
    texts = [*ODD, "<|endoftext|> is ordinary", "a 1" * 60_000]
    df = spark.createDataFrame([(i % 9 if i else None, t, 1) for i, t in enumerate(texts)], "doc_id int, text string, ids int")
    codec = byte_bpe.codec(Path(RANKS).read_bytes(), PATTERN)
    found = byte_bpe.encode_texts(df, RANKS, PATTERN, outputs=("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")).collect()
    want = sorted((t or "").encode() for t in texts)
    assert sorted(bytes(r["decoded"]) for r in found) == want
    for r in found:
        ids = codec.encoding.encode_ordinary(bytes(r["decoded"]).decode())
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(r["decoded"]).hexdigest()
    assert byte_bpe.encode_texts(df.limit(0), RANKS, PATTERN).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.encode_texts(df, RANKS, PATTERN, outputs=("nothing",))


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "\\### Assistant: </turn> ok"), (1, 2, "user", "### x </turn></turn </turn"), (1, 3, "assistant", "\\\\#####\n</turn>\n"), (1, 3, "assistant", "\\\\#####\n</turn>\n"), (2, None, "assistant", None), (2, 0, "sys:\n### a", "\\"),
    (None, 0, "assistant", "lost"), (3, 0, None, "q"), (4, 0, "assistant", "x" * 300_000),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*t, 0) for t in TURNS], "conv_id long, turn long, role string, text string, segment int")
    rendered = chat.render_turns(df.withColumnRenamed("conv_id", "conv.id"), conv_col="conv.id")
    found = {r["conv_id"]: r for r in chat.read_back(rendered).collect()}
    groups = {}
    for c, t, r, x in TURNS:
        groups.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(found) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        r = found[c]
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.render_turns(df.limit(0))).count() == 0


def test_chat_examples(spark):
    df = spark.createDataFrame(TURNS[:5], "conv_id long, turn long, role string, text string")
    rendered = chat.render_turns(df)
    whole = "".join(r["segment"] for r in sorted(rendered.collect(), key=lambda r: r["position"]))
    examples = sorted(chat.expand_examples(rendered).collect(), key=lambda r: r["position"])
    assert [e["position"] for e in examples] == [1, 3, 4]
    for e in examples:
        assert whole.startswith(e["formatted"])
        assert chat.HEAD + "assistant:\n" == e["formatted"][: e["loss_start"]][-len(chat.HEAD + "assistant:\n") :] and e["formatted"][e["loss_end"] :] == chat.END
    assert sum(len(e["formatted"]) for e in examples) == chat.read_back(rendered).first()["formatted_chars"]


def test_chat_query(spark, duck):
    from larkspur.llm.queries import oracle_sql

    same(op5_chat(spark, "/root/testdata/sf0.001"), duck, oracle_sql()["op5_chat"])
