"""Importance resampling of documents towards a target distribution of hashed n-grams.

Line breaks part words, so a text is a row of lines, and most n-grams lie inside one line.  Lines recur:
each distinct line of the corpus is cut into features once, and its counts are multiplied by how often
the line occurs.  N-grams that reach over a line break are counted apart, text by text.  The weight of a
document is put together the same way: weights of its lines, joined by digest, and of its crossing
n-grams.  Lines that fill more than a thousandth of all lines are few, and joined by broadcast.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqimpact.llm.store import stored
from dqimpact.operators.running import running_totals

BUCKETS = 10_000
# A line is hot from this share of all lines on; so there are at most as many hot lines.
HOT_SHARE = 1_000
REMEMBERED = 500_000
# Buckets that travel in one row of partial totals.
SLICE = 500
# A byte of a word, in texts whose ASCII letters are small.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_HAS_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


class _Buckets(dict):
    """Buckets of features, remembered up to a bound."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.buckets
        if len(self) < REMEMBERED:
            self[feature] = bucket
        return bucket


def _words(text: str | None) -> list[bytes]:
    return _WORD.findall(text.encode().lower()) if text else []


def _runs(words: Sequence[bytes], longest: int) -> Iterator[bytes]:
    yield from words
    for size in range(2, longest + 1):
        for i in range(len(words) - size + 1):
            yield b" ".join(words[i : i + size])


def _crossing(text: str | None, longest: int) -> Iterator[bytes]:
    """The runs of words that begin on one line and end on a later one."""
    words, line = [], []
    for number, part in enumerate((text or "").split("\n")):
        found = _words(part)
        words += found
        line += [number] * len(found)
    for size in range(2, longest + 1):
        for i in range(len(words) - size + 1):
            if line[i] != line[i + size - 1]:
                yield b" ".join(words[i : i + size])


def _lists(rows: list[list[int]]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    flat = np.fromiter((b for r in rows for b in r), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))


def rows_of(table: DataFrame, key: str | None, text: str) -> DataFrame:
    """doc, version, text: `version` tells rows apart that share a key."""
    string = F.col(f"`{text}`").cast("string")
    number = F.col(f"`{key}`").cast("long") if key else F.lit(None).cast("long")
    return table.select(number.alias("doc"), F.xxhash64(string).alias("version"), string.alias("text"))


def _lines(text: str = "text") -> Column:
    """The lines of a text that hold a word."""
    return F.filter(F.split(F.col(text), "\n"), lambda line: line.rlike(_HAS_WORD))


def distinct_lines(rows: DataFrame, longest: int, buckets: int) -> DataFrame:
    """digest, times, n_words, features: each line once, with the buckets of its features."""
    counted = rows.select(F.explode(_lines()).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("times"))
    named = counted.select(F.unhex(F.md5("line")).alias("digest"), "times", "line")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _Buckets(buckets)
        for batch in batches:
            words = [_words(line) for line in batch.column(2).to_pylist()]
            features = [list(map(bucket.__getitem__, _runs(w, longest))) for w in words]
            counts = pa.array([len(w) for w in words], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), counts, _lists(features)],
                names=["digest", "times", "n_words", "features"],
            )

    return named.mapInArrow(cut, "digest binary, times long, n_words long, features array<int>")


def crossing_features(rows: DataFrame, longest: int, buckets: int) -> DataFrame:
    """doc, version, features of the n-grams over line breaks, for texts that have some."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _Buckets(buckets)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                features = [list(map(bucket.__getitem__, _crossing(t, longest))) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), _lists(features)], names=["doc", "version", "features"]
                )

    several = rows.filter(F.col("text").contains("\n"))
    return several.mapInArrow(cut, "doc long, version long, features array<int>").filter(F.size("features") > 0)


def bucket_totals(parts: Sequence[DataFrame], buckets: int) -> list[int]:
    """How many features fall into each bucket; `parts` hold (times, features)."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            times = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes)
            np.add.at(totals, lists.flatten().to_numpy(zero_copy_only=False), times)
        places = np.arange(0, buckets, SLICE)
        slices = pa.array([totals[at : at + SLICE].tobytes() for at in places], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(places), slices], names=["place", "totals"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[place] = found.get(place, 0) + np.frombuffer(part, np.int64)
        slices = pa.array([x.tobytes() for x in found.values()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), slices], names=["place", "totals"])

    made = reduce(DataFrame.unionByName, [p.select("times", "features") for p in parts])
    slices = made.mapInArrow(summed, "place long, totals binary").repartition("place")
    found = np.zeros(buckets, np.int64)
    for row in slices.mapInArrow(merged, "place long, totals binary").collect():
        part = np.frombuffer(row["totals"], np.int64)
        found[row["place"] : row["place"] + len(part)] += part
    return found.tolist()


def gains(corpus: Sequence[int], target: Sequence[int]) -> list[int]:
    """What one feature of each bucket adds to a weight, in thousandths, rounded down."""
    s, t, n = sum(corpus), sum(target), len(corpus)
    return [
        math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(corpus, target, strict=True)
    ]


def _weighed(rows: DataFrame, gain: Sequence[int]) -> DataFrame:
    """The rows with n_features and weight instead of their features."""
    kept = [c for c in rows.columns if c != "features"]
    value = np.array(gain, np.int64)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
            sums = np.concatenate(([0], np.cumsum(value[lists.flatten().to_numpy(zero_copy_only=False)])))
            starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
            made = [pa.array(ends - starts), pa.array(sums[ends] - sums[starts])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *made], names=[*kept, "n_features", "weight"]
            )

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"{c} {types[c]}" for c in kept), "n_features long", "weight long"])
    return rows.select(*kept, "features").mapInArrow(weigh, schema)


def _joined(uses: DataFrame, lines: DataFrame, of_all: int) -> DataFrame:
    """Each use of a line with the line's numbers."""
    hot = F.col("times") * HOT_SHARE > of_all
    few, rest = lines.filter(hot).drop("times"), lines.filter(~hot).drop("times")
    by_broadcast = uses.join(F.broadcast(few), "digest")
    others = uses.join(F.broadcast(few.select("digest")), "digest", "left_anti").join(rest, "digest")
    return by_broadcast.unionByName(others)


def document_weights(docs: DataFrame, target: DataFrame, longest: int, buckets: int, key: str, text: str) -> DataFrame:
    """doc, n_words, n_features, weight for every row of `docs`."""
    rows, aims = rows_of(docs, key, text), rows_of(target, None, text)
    lines = stored(distinct_lines(rows, longest, buckets), "lines")
    once = F.lit(1).cast("long").alias("times")
    corpus, wanted = [lines], [distinct_lines(aims, longest, buckets)]
    crossing = None
    if longest > 1:
        crossing = stored(crossing_features(rows, longest, buckets), "crossing")
        corpus.append(crossing.select(once, "features"))
        wanted.append(crossing_features(aims, longest, buckets).select(once, "features"))
    gain = gains(bucket_totals(corpus, buckets), bucket_totals(wanted, buckets))

    # A null stands for the row itself, so that rows without words are kept and equal rows are counted.
    digests = F.transform(_lines(), lambda line: F.unhex(F.md5(line)))
    digests = F.concat(F.array(F.lit(None).cast("binary")), F.coalesce(digests, F.array().cast("array<binary>")))
    uses = stored(rows.select("doc", "version", F.explode(digests).alias("digest")), "uses")
    of_all = lines.agg(F.sum("times")).first()[0] or 0
    numbers = ["n_words", "n_features", "weight"]
    zero = [F.lit(0).cast("long").alias(c) for c in numbers]
    parts = [
        uses.filter("digest is null").select("doc", "version", F.lit(1).cast("long").alias("row"), *zero),
        _joined(uses.filter("digest is not null"), _weighed(lines, gain), of_all).select("doc", "version", zero[0].alias("row"), *numbers),
    ]
    if crossing is not None:
        parts.append(_weighed(crossing, gain).select("doc", "version", zero[0].alias("row"), zero[0], "n_features", "weight"))
    summed = reduce(DataFrame.unionByName, parts).groupBy("doc", "version").agg(
        F.sum("row").alias("copies"), *[F.sum(c).alias(c) for c in numbers]
    )
    each = [F.expr(f"{c} div copies").alias(c) for c in numbers]
    return summed.select("doc", *each, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")


def _gumbel(doc: Column, seed: str) -> Column:
    """Noise in thousandths from a digest of the document's number."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    longest: int = 1,
    buckets: int = BUCKETS,
    percent: int = 10,
    least_words: int = 20,
    seed: str = "2024",
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score, rank, n_words for every row of `docs`.

    `percent` of the documents with `least_words` words are drawn without replacement, by the highest
    scores (weight plus Gumbel noise); rank counts them from 1, ties going to the smaller doc_id, and is
    null for the others.  Defined results for odd rows: a null or empty text has no words, weight 0 and
    is not drawn; rows that share a doc_id get each the result of their own text (and are drawn as often as they
    score); a row without doc_id has no score and is never drawn nor counted; further columns are left
    out.  Two different lines are taken for one if their 128-bit digests are equal.
    """
    weights = document_weights(docs, target, longest, buckets, key, text)
    scored = weights.withColumn("score", F.col("weight") + _gumbel(F.col("doc"), seed))
    scored = stored(scored.withColumn("falling", -F.col("score")), "scored")
    fit = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
    able = scored.filter(fit)
    drawn = able.count() * percent // 100
    placed = running_totals(able, [], ["falling", "doc"], {"before": F.lit(1).cast("long")})
    ranked = placed.withColumn("rank", F.when(F.col("before") < drawn, F.col("before") + 1)).drop("before")
    whole = ranked.unionByName(scored.filter(~fit).withColumn("rank", F.lit(None).cast("long")))
    return whole.select(F.col("doc").alias("doc_id"), "n_features", "weight", "score", "rank", "n_words")
