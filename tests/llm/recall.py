"""Recall of the near-dedup forest against all pairs: ``python -m tests.llm.recall [FOLDER [LEAST]]``.

All pairs of distinct texts of FOLDER/documents.parquet with a Jaccard similarity of LEAST or more are
found exactly, by prefix filtering: two such sets share one of the rarest (1 - LEAST) n + 1 shingles
of each. Prints, for each band of similarity, the pairs and the share in one class; and, for a limit
of 0.8, how many true groups were parted and how many classes join two of them.
"""

import re
import sys
from collections import defaultdict

import numpy as np
import pyarrow.dataset as ds

from larkspur.llm import neardup
from larkspur.session import session, ship_package

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(words):
    k = neardup.SHINGLE
    return {hash(tuple(words[i : i + k])) for i in range(len(words) - k + 1)} if len(words) >= k else {hash(tuple(words))}


def all_pairs(texts, least):
    """(i, j, similarity) of all pairs of ``least`` or more."""
    sets = [np.fromiter(s, np.int64, len(s)) for s in map(shingles, texts)]
    values, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    index, begin = defaultdict(list), 0
    for i, s in enumerate(sets):
        own = at[begin : begin + len(s)]
        begin += len(s)
        rare = own[np.lexsort((own, counts[own]))][: int((1 - least) * len(s)) + 1]
        for v in rare[counts[rare] > 1].tolist():
            index[v].append(i)
    seen, out = set(), []
    sets = [np.sort(s) for s in sets]
    for docs in index.values():
        for x, i in enumerate(docs):
            for j in docs[x + 1 :]:
                if (i, j) not in seen and min(len(sets[i]), len(sets[j])) >= least * max(len(sets[i]), len(sets[j])):
                    seen.add((i, j))
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if (like := both / (len(sets[i]) + len(sets[j]) - both)) >= least:
                        out.append((i, j, like))
    return out


def main(folder="/root/testdata/check_s", least=0.8):
    spark = session("recall", "local[8]", spark__sql__shuffle__partitions="16", spark__ui__enabled="false", spark__driver__memory="6g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    found = {r["doc_id"]: r["class_id"] for r in neardup.near_classes(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    spark.stop()
    first = {}
    for doc, text in sorted(zip(*(ds.dataset(f"{folder}/documents.parquet").to_table(["doc_id", "text"]).column(c).to_pylist() for c in (0, 1)), strict=True)):
        if text and (words := tuple(WORD.findall(text))):
            first.setdefault(words, doc)
    ids = list(first.values())
    pairs = all_pairs(list(first), least)
    bands = defaultdict(lambda: [0, 0])
    for i, j, like in pairs:
        band = bands[int(like * 20 + 1e-9) / 20]
        band[0] += 1
        band[1] += found[ids[i]] == found[ids[j]]
    for low, (n, one) in sorted(bands.items()):
        print(f"similarity {low:.2f} to {low + 0.05:.2f}: {n} pairs, {one / n:.4f} in one class")
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    near = [(i, j) for i, j, like in pairs if like >= 0.8]
    for i, j in near:
        root[top(i)] = top(j)
    groups, classes = defaultdict(set), defaultdict(set)
    for i in list(root):
        groups[top(i)].add(found[ids[i]])
        classes[found[ids[i]]].add(top(i))
    alone = {found[ids[i]] for i in range(len(ids)) if i not in root}
    print(f"{len(ids)} texts, {len(near)} pairs of 0.8 or more, {np.mean([found[ids[i]] == found[ids[j]] for i, j in near]):.5f} in one class; {sum(len(c) > 1 for c in groups.values())} of {len(groups)} groups parted; {sum(len(g) > 1 for g in classes.values())} classes join groups, {len(alone & set(classes))} take in a text without a pair")


if __name__ == "__main__":
    main(*sys.argv[1:2], *map(float, sys.argv[2:3]))
