"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

The statistics come from the text alone.  The trees are fitted on a bounded sample of the labelled rows:
the features are cut into bins at quantiles, and every split is found from sums of gradients over bins.
All trees are perfect binary trees, flattened into three arrays, and a batch of documents walks through
all of them at once, one level at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqimpact.llm.hashed import WordHashes, runs

MAX_LABELLED = 20_000

FEATURES = (
    "log_words", "word_length", "upper", "digit", "symbol", "exclaim", "stop", "comma", "other_mark", "wide", "space",
    "distinct_words", "distinct_runs", "echo", "top_word", "marked_words", "log_lines", "distinct_lines",
)


def _class_table() -> np.ndarray:
    table = np.full(256, 8, np.int64)
    for kind, members in enumerate(
        (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!", b".?", b",;:", b" \t\n\r\x0b\x0c")
    ):
        table[list(members)] = kind
    table[128:] = 9
    return table


CLASSES = _class_table()


def statistics(text: str | None, hashes: WordHashes) -> list[float]:
    """One row of FEATURES; shares are 0 for an empty text."""
    raw = (text or "").encode()
    words = raw.lower().split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(CLASSES[np.frombuffer(raw, np.uint8)], minlength=10) / len(raw)
    known = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    _, counts = np.unique(known, return_counts=True)
    triples = runs(known, min(3, n))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    letters = kinds[0] + kinds[1] + kinds[9]
    return [
        float(np.log1p(n)),
        sum(map(len, words)) / n,
        kinds[1] / max(letters, 1e-9),
        kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[8], kinds[9], kinds[7],
        len(counts) / n,
        len(np.unique(triples)) / len(triples),
        float(np.count_nonzero(known[1:] == known[:-1])) / n,
        float(counts.max()) / n,
        sum(1 for w in words if w[-1:] in b"#*$%&|<>!" ) / n,
        float(np.log1p(len(lines))),
        len(set(lines)) / max(len(lines), 1),
    ]


@dataclass
class Trees:
    """Perfect trees of one depth: inner nodes and leaves in level order, one row for each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        margin = np.full(len(rows), self.base)
        trees, inner = self.feature.shape
        if trees and len(rows):
            node = np.zeros((len(rows), trees), np.int64)
            tree, each = np.arange(trees), np.arange(len(rows))[:, None]
            while int(node[0, 0]) < inner:
                right = rows[each, self.feature[tree, node]] > self.threshold[tree, node]
                node = 2 * node + 1 + right
            margin = margin + self.leaf[tree, node - inner].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-margin))


@dataclass(frozen=True)
class Settings:
    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 64
    penalty: float = 1.0
    least_weight: float = 1.0


def fit(rows: np.ndarray, labels: np.ndarray, settings: Settings = Settings()) -> Trees:
    """Boosted trees for the logistic loss; with one class only, its share stands for all."""
    inner = 2**settings.depth - 1
    share = (labels.sum() + 1.0) / (len(labels) + 2.0)
    base = float(np.log(share / (1.0 - share)))
    if not len(labels) or labels.min() == labels.max():
        empty = np.zeros((0, inner))
        return Trees(empty.astype(np.int64), empty, np.zeros((0, inner + 1)), base)
    width = rows.shape[1]
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, settings.bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], rows[:, f], side="left") for f in range(width)], axis=1)
    bins = settings.bins
    margin = np.full(len(labels), base)
    made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(settings.trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        gradient, weight = p - labels, p * (1.0 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(labels), np.int64)
        for level in range(settings.depth):
            first, many = 2**level - 1, 2**level
            local = node - first
            best = np.zeros(many)
            cut = np.zeros(many, np.int64)
            for f in range(width):
                if not len(edges[f]):
                    continue
                cell = local * bins + binned[:, f]
                g = np.bincount(cell, gradient, many * bins).reshape(many, bins).cumsum(axis=1)
                h = np.bincount(cell, weight, many * bins).reshape(many, bins).cumsum(axis=1)
                rest_g, rest_h = g[:, -1:] - g, h[:, -1:] - h
                gain = g**2 / (h + settings.penalty) + rest_g**2 / (rest_h + settings.penalty)
                gain -= g[:, -1:] ** 2 / (h[:, -1:] + settings.penalty)
                gain[(h < settings.least_weight) | (rest_h < settings.least_weight)] = 0
                gain = gain[:, : len(edges[f])]
                place = gain.argmax(axis=1)
                value = gain[np.arange(many), place]
                better = value > best + 1e-12
                best[better], cut[better] = value[better], place[better]
                feature[first : first + many][better] = f
                threshold[first : first + many][better] = edges[f][place[better]]
            node = 2 * node + 1 + (rows[np.arange(len(rows)), feature[node]] > threshold[node])
        leaf_of = node - inner
        g = np.bincount(leaf_of, gradient, inner + 1)
        h = np.bincount(leaf_of, weight, inner + 1)
        leaf = -settings.rate * g / (h + settings.penalty)
        margin = margin + leaf[leaf_of]
        made.append((feature, threshold, leaf))
    return Trees(*(np.stack(x) for x in zip(*made, strict=True)), base)


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: the crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), max_labelled: int = MAX_LABELLED) -> Trees:
    """Trees from `max_labelled` labelled rows at most, those whose ids have the smallest hashes."""
    known = labels.filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id")))
    chosen = known.select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labelled)
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = [statistics(text.as_py(), hashes) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["quality", "row"])

    found = met.mapInArrow(measure, "quality int, row array<double>").collect()
    # The order of collected rows is not fixed; sums over it should be.
    pairs = sorted((row["quality"], row["row"]) for row in found)
    rows = np.array([row for _, row in pairs]).reshape(len(pairs), len(FEATURES))
    return fit(rows, np.array([quality == 1 for quality, _ in pairs], float), settings)


def score_quality(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, held_out and score of every row.

    Defined results for odd rows: a null or empty text has statistics of 0 and a score like any other; a
    row without doc_id is not held out; labels with a null are left out of the fit and without labels every
    score is a half; repeated rows score alike; further columns are left out.
    """
    whole = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    sent = docs.sparkSession.sparkContext.broadcast((trees.feature, trees.threshold, trees.leaf, trees.base))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, model = WordHashes(), Trees(*sent.value)
        for batch in batches:
            rows = np.array([statistics(text.as_py(), hashes) for text in batch.column(2)])
            scores = model.scores(rows.reshape(batch.num_rows, len(FEATURES)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores)], names=["doc_id", "held_out", "score"]
            )

    return whole.mapInArrow(score, "doc_id long, held_out boolean, score double")
