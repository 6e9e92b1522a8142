"""Importance resampling against a plain version that counts every text as a whole."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from dqimpact.llm import resample
from tests import compare

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, target, longest, buckets, percent, least):
    def features(text):
        words = WORD.findall((text or "").translate(LOW))
        runs = [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
        return len(words), Counter(zlib.crc32(r.encode()) % buckets for r in runs)

    made = [(doc, *features(text)) for doc, text in docs]
    s, t = Counter(), Counter()
    for _, _, found in made:
        s.update(found)
    for _, text in target:
        t.update(features(text)[1])
    gain = {
        b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s
    }
    rows, able = [], []
    for doc, words, found in made:
        weight, score = sum(gain[b] * n for b, n in found.items()), None
        if doc is not None:
            h = int(hashlib.sha256(f"2024:{doc}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if words >= least:
                able.append((-score, doc, len(rows)))
        rows.append([doc, found.total(), weight, score, None, words])
    for place, (_, _, row) in enumerate(sorted(able)[: percent * len(able) // 100]):
        rows[row][4] = place + 1
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("longest", [1, 3])
@pytest.mark.parametrize("hot_share", [resample.HOT_SHARE, 5])
def test_whole_table_against_plain_python(spark, folder, monkeypatch, longest, hot_share):
    monkeypatch.setattr(resample, "HOT_SHARE", hot_share)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text")
    wanted = plain(docs.collect(), target.collect(), longest, 1_000, 25, 20)
    got = resample.importance_resample(docs, target, longest, 1_000, 25)
    assert compare.rows_of_spark(got)[1] == sorted((tuple(dict(zip(got.columns, r, strict=True))[c] for c in sorted(got.columns)) for r in wanted), key=repr)


def test_odd_rows(spark):
    long = "\n".join(f"Line {i % 7} of a very long text ÄÖ" for i in range(20_000))
    odd = [
        (1, None), (2, ""), (3, " \n\n ... \n"), (4, "twenty words " * 10), (4, "twenty words " * 10),
        (4, "another text " * 12), (None, "no id at all " * 20), (5, long), (6, "one\ntwo\n" * 15), (7, "Tie\r\nTie"),
    ]
    schema = "doc_id long, text string, digest string, weight string, rank string, `n.words` int, Score int"
    docs = spark.createDataFrame([(i, t, "x", "y", "z", 1, 2) for i, t in odd], schema)
    target = spark.createDataFrame([(1, "twenty words"), (2, None)], "item_id long, text string")
    for longest in (1, 2):
        got = resample.importance_resample(docs, target, longest, 50, 50, 10).collect()
        assert sorted((tuple(r) for r in got), key=repr) == plain(odd, [(1, "twenty words"), (2, None)], longest, 50, 50, 10)
    none = docs.filter("false")
    assert resample.importance_resample(none, target).count() == 0
    alone = resample.importance_resample(docs, target.filter("false")).collect()
    assert sorted((tuple(r) for r in alone), key=repr) == plain(odd, [], 1, resample.BUCKETS, 10, 20)
