"""Operator 1: URL filters by logistic regression on hashed character n-grams of host and path.

The model is fitted on the driver from a small labelled URL table (at most ``MAX_LABELLED`` rows)
and its weights are rounded to integers, so a score is an exact sum. Scoring uses SQL functions only:
a map over rows without shuffles or Python.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import cut, free, keep, quoted

BUCKETS, SIZES, SCALE, MAX_LABELLED, PLAN_RULES = 4096, (3, 4), 1000, 100_000, 1000
_BASE, _PRIME = 1009, 2_147_483_629
_HOST_MARK, _PATH_MARK = 2, 3

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

_TABLE = Path(__file__).with_name("labelled_urls.tsv")


def labelled_urls(path: Path = _TABLE) -> list[tuple[str, str, int]]:
    """The labelled table: host, path, 1 for URLs to block."""
    rows = [line.split("\t") for line in Path(path).read_text(encoding="utf-8").splitlines()[1:]]
    return [(host, where, int(label)) for label, host, where in rows]


def features(host: str, path: str, buckets: int = BUCKETS) -> list[int]:
    """Bucket of each n-gram; those of host and path fall in buckets of their own halves."""
    out = []
    for mark, text in ((_HOST_MARK, host), (_PATH_MARK, path)):
        codes = [mark, *map(ord, text), mark]
        for n in SIZES:
            for i in range(len(codes) - n + 1):
                h = mark
                for c in codes[i : i + n]:
                    h = (h * _BASE + c) % _PRIME
                out.append(h % (buckets // 2) + (buckets // 2 if mark == _PATH_MARK else 0))
    return out


@dataclass(frozen=True)
class UrlModel:
    """Integer weights (times ``SCALE``) for each bucket; a URL is blocked at a score above 0."""

    weights: tuple[int, ...]
    bias: int

    def score(self, host: str, path: str) -> int:
        return self.bias + sum(self.weights[i] for i in features(host, path, len(self.weights)))


@lru_cache(1)
def default_model() -> UrlModel:
    return fit(labelled_urls())


def fit(rows: list[tuple[str, str, int]], buckets: int = BUCKETS, steps: int = 300, l2: float = 1e-3, rate: float = 4.0) -> UrlModel:
    """Full-batch gradient descent on length-normalised counts, classes weighted equally.

    Every sum runs in one fixed order in double precision (no matrix products, whose order depends
    on threads and processor), and weights are rounded to 1 / ``SCALE``, far above what is left of
    rounding errors: the same table gives the same integers in any process.
    """
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"fit takes at most {MAX_LABELLED} labelled URLs")
    found = [features(host, path, buckets) for host, path, _ in rows]
    row = np.repeat(np.arange(len(rows)), [len(f) for f in found])
    column = np.array([i for f in found for i in f], dtype=np.int64)
    y = [label for *_, label in rows]
    share = [0.5 / max(1, sum(1 for x in y if x == label)) for label in y]
    w, b = np.zeros(buckets), 0.0
    for _ in range(steps):
        margin = np.bincount(row, w[column], len(rows)) + b
        gap = np.array([s * (1 / (1 + math.exp(-max(-500.0, min(500.0, m)))) - t) for m, s, t in zip(margin.tolist(), share, y, strict=True)])
        w -= rate * (np.bincount(column, gap[row], buckets) / 10 + l2 * w)
        b -= rate * math.fsum(gap) / 10
    return UrlModel(tuple(int(v) for v in np.round(w * SCALE)), int(round(b * SCALE)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (ties: the smaller string) and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), *[-ord(c) for c in r[0] + r[1]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def join_rules(pages: DataFrame, host: str, path: str, rules: Sequence[tuple[str, str, str]], name: str, verdict: str) -> DataFrame:
    """``pages`` with the columns ``name`` and ``verdict`` of ``rule_of``, by a join on host suffixes instead of one expression a rule.

    Each distinct (host, path) meets the rules of its suffixes (of as many labels as a rule has);
    the deciding ones are written before they are joined back, so that hot hosts can be split.
    """
    table = pages.sparkSession.createDataFrame([(h, p, v) for h, p, v in rules], "h string, p string, v string")
    most = max(r[0].count(".") + 1 for r in rules)
    seen = pages.select(F.col(host).alias("x"), F.col(path).alias("y")).distinct().withColumn("l", F.split("x", r"\.", -1))
    suffixes = seen.select("x", "y", F.explode(F.expr(f"transform(sequence(1, least(size(l), {most})), k -> array_join(slice(l, -k, k), '.'))")).alias("h"))
    fits = suffixes.join(table, "h").where(F.col("y").startswith(F.col("p"))).withColumn("rule", F.concat("h", "p"))
    best = cut(fits.groupBy("x", "y").agg(F.min(F.struct((-F.char_length("rule")).alias("n"), "rule", "v")).alias("b")).select("x", "y", F.col("b.rule").alias(name), F.col("b.v").alias(verdict)))
    return pages.join(best, (F.col(host) == F.col("x")) & (F.col(path) == F.col("y")), "left").drop("x", "y")


def _grams(text: str, mark: int, buckets: int, weights: str) -> str:
    """SQL: the sum of the weights of all n-grams of column ``text``."""
    half = buckets // 2
    shift = half if mark == _PATH_MARK else 0
    codes = f"concat(array({mark}L), transform(filter(split({text}, ''), c -> c <> ''), c -> cast(ascii(c) as bigint)), array({mark}L))"
    parts = []
    for n in SIZES:
        h = f"{mark}L"
        for k in range(n):
            h = f"(({h} * {_BASE}L + get(s.codes, i{f' + {k}' if k else ''})) % {_PRIME}L)"
        parts.append(f"if(size(s.codes) < {n}, 0L, aggregate(sequence(0, size(s.codes) - {n}), 0L, (t, i) -> t + get({weights}, cast({h} % {half} + {shift} as int))))")
    return f"element_at(transform(array(named_struct('codes', {codes})), s -> {' + '.join(parts)}), 1)"


def filter_urls(pages: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str, str]] = RULES, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict (allow or block) and score (an integer).

    A rule (host, path, verdict) fits its host and all subdomains where the URL's path starts with
    the rule's; the longest decides; without one the model does (block where the score is above 0).
    Null URLs and URLs without ``://`` have an empty host and path, fit no rule and are judged by
    the model on empty texts. All rows stay, repeated ones too; input columns of these names are
    replaced; an empty table stays empty. URLs of any length are scored whole, in linear time. Up to
    ``PLAN_RULES`` rules are part of the expression; more are joined on host suffixes.
    """
    url = F.col(quoted(url_col))
    h, p, s, r, v = free(pages, "_host", "_path", "_score", "_rule", "_verdict")
    base = pages.withColumn(h, host_of(url)).withColumn(p, path_of(url))
    weights = f"cast(split('{','.join(map(str, model.weights))}', ',') as array<int>)"
    size = len(model.weights)
    score = F.expr(f"{model.bias}L + {_grams(h, _HOST_MARK, size, weights)} + {_grams(p, _PATH_MARK, size, weights)}")
    if len(rules) > PLAN_RULES:
        base = join_rules(base, h, p, rules, r, v)
        name, verdict = F.col(r), F.col(v)
    else:
        name, verdict = rule_of(F.col(h), F.col(p), rules)
    judged = keep(base.withColumn(s, score), {"host": F.col(h), "path": F.col(p), "rule": name, "verdict": F.coalesce(verdict, F.when(F.col(s) > 0, "block").otherwise("allow")), "score": F.col(s)})
    return judged.drop(h, p, s, r, v)
