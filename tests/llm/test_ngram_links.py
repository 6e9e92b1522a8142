"""All links between different sets, and their number for each document, against all pairs."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dqimpact.llm import ngram_join


def _sets(texts, width):
    for text in texts:
        words = text.split()
        yield frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


@pytest.mark.parametrize("narrow", [0, 64])
def test_links_of_random_families(spark, monkeypatch, narrow):
    monkeypatch.setattr(ngram_join, "NARROW", narrow)
    rng = np.random.default_rng(11)
    texts = []
    for family in range(5):
        base = [f"f{family}w{i}" for i in range(int(rng.integers(30, 110)))]
        for _ in range(20):
            words = list(base)
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(0, len(words)))] = f"x{rng.integers(0, 30)}"
            texts.append(" ".join(words[: len(words) - int(rng.integers(0, 4))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes, links = ngram_join.ngram_links(docs, 3, 80)

    sets = list(_sets(texts, 3))
    node = {s: min(i for i, t in enumerate(sets) if t == s) for s in set(sets)}
    alike = {
        (i, j)
        for i in range(len(sets))
        for j in range(len(sets))
        if i != j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    }
    wanted = {tuple(sorted((node[sets[i]], node[sets[j]]))) for i, j in alike if sets[i] != sets[j]}
    assert len(wanted) > 100
    found = [tuple(sorted(r)) for r in links.collect()]
    assert len(found) == len(set(found)) and set(found) == wanted
    assert {r["doc_id"]: r["node"] for r in classes.collect()} == {i: node[s] for i, s in enumerate(sets)}

    # The number of links of every document follows from the sizes of classes.
    sizes = classes.groupBy("node").agg(F.count(F.lit(1)).alias("size"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(sizes, F.col("b") == sizes["node"]).groupBy("a").agg(F.sum("size").alias("others"))
    counted = classes.join(sizes, "node").join(others, F.col("node") == F.col("a"), "left")
    counted = counted.select("doc_id", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    plain = Counter(i for i, _ in alike)
    assert {r["doc_id"]: r["n_links"] for r in counted.collect()} == {i: plain[i] for i in range(len(sets))}


def test_links_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "a b"), (None, "a b"), (5, "a b c d e f g h i j"), (5, "other text here")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    classes, links = ngram_join.ngram_links(docs)
    assert links.count() == 0
    assert sorted(((r["doc_id"] or 0, r["node"] or 0) for r in classes.collect())) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 5), (5, 5)]
