"""Cross-entropy difference of two n-gram models: how much rather a text comes from the target than from the corpus.

Both models are bigram models with the same vocabulary and the same smoothing.  The vocabulary has every
word that occurs `LEAST` times in the corpus, however large the corpus is; all others are one unknown word.
Counts cover the whole corpus (background) and all labelled target documents, and are kept apart for each
word and each bigram, so they grow with the corpus; no model is sent to the driver or to all tasks.

Documents are stored in chunks of about `CHUNK` words.  A chunk sends its distinct words with their counts to tasks
that each own a range of keys; these add up what all chunks sent and answer each chunk with the totals of its own
keys.  It then knows its rare words and sends its known words and bigrams in the same way.  So a frequent key is one
entry for each chunk, not one for each document.  A hash of 64 bits stands for a word and for a bigram.
"""

from __future__ import annotations

import secrets
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqimpact.llm.hashed import WordHashes, runs
from dqimpact.llm.store import stored

# Hashes of the unknown word, of the start and of the end of a text, and of all that can be predicted.
UNKNOWN, START, END, ALL = 0, 1, 2, 3
# A word that makes up a part in WORDS of 65,537 to 131,072 tokens is met twice; LEAST is that count for any corpus.
WORDS = 1 << 16
LEAST = 2
# Bits that tell bigrams apart.
BIGRAM_BITS = 64
# Words after which a chunk ends with the document that it is in.
CHUNK = 1 << 20

_CHUNKS = "chunk long, doc_ids binary, unnamed binary, lengths binary, words binary, times binary, places binary"
_ASKED = "part int, chunk long, n_keys long, keys binary, n binary, n_target binary"
_ANSWERS = "chunk long, part int, n binary, n_target binary, kept long"
_SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


@dataclass(frozen=True)
class Smoothing:
    """Weight of the word's own share in its bigrams, and what is added to the count of a word."""

    backoff: float = 5.0
    added: float = 0.5


def _planes(values: np.ndarray, width: int) -> bytes:
    """All first bytes, then all second ones: the highest are nearly all zero."""
    return values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _of_planes(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(width, -1).T.copy().view(f"<u{width}").ravel()


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs; the first byte is the width."""
    top = int(values.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + zlib.compress(_planes(values, width), 6)


def _unpacked(data: bytes) -> np.ndarray:
    return _of_planes(zlib.decompress(data[1:]), data[0]).astype(np.int64)


def _keyed(keys: np.ndarray) -> bytes:
    """Sorted keys as the bytes of their differences."""
    return zlib.compress(_planes(np.diff(keys, prepend=np.uint64(0)), 8), 1)


def _keys(data: bytes) -> np.ndarray:
    return np.cumsum(_of_planes(zlib.decompress(data), 8), dtype=np.uint64)


def _by_frequency(times: np.ndarray) -> np.ndarray:
    """Places of words in the order of how often they stand in the chunk, so that most words get a small number."""
    return np.argsort(-times, kind="stable")


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    named = [part.split() for part in schema.split(", ")]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, types[kind]) for c, (_, kind) in zip(columns, named, strict=True)], names=[name for name, _ in named]
    )


def _chunked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) as chunks: distinct words, and where each of them stands."""
    hashes = WordHashes()
    ids: list[int | None] = []
    texts: list[np.ndarray] = []
    held = 0

    def chunk() -> pa.RecordBatch:
        words, places, times = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
        numbers = np.empty(len(words), np.int64)
        numbers[_by_frequency(times)] = np.arange(len(words))
        row = (
            secrets.randbits(63),
            np.array([i or 0 for i in ids], "<i8").tobytes(),
            np.array([i is None for i in ids], np.uint8).tobytes(),
            np.array([len(t) for t in texts], "<i8").tobytes(),
            _keyed(words),
            _packed(times),
            _packed(numbers[places]),
        )
        return _batch(_CHUNKS, [row])

    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            words = text.as_py().encode().split() if text.is_valid else []
            texts.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
            ids.append(doc.as_py())
            held += len(words)
            # Empty texts count as well, so that a chunk has not too many of them.
            if held + len(texts) >= size:
                yield chunk()
                ids, texts, held = [], [], 0
    if texts:
        yield chunk()


class _Chunk:
    def __init__(self, row: dict):
        self.id = row["chunk"]
        self.doc_ids = np.frombuffer(row["doc_ids"], "<i8")
        self.unnamed = np.frombuffer(row["unnamed"], np.uint8).astype(bool)
        self.lengths = np.frombuffer(row["lengths"], "<i8")
        self.words = _keys(row["words"])
        self.times = _unpacked(row["times"])
        self.places = _by_frequency(self.times)[_unpacked(row["places"])]

    def lines(self, known: np.ndarray) -> np.ndarray:
        """The keys of all words, with a start and an end about each text."""
        ends = np.cumsum(self.lengths + 2)
        made = np.empty(ends[-1], np.uint64)
        inner = np.ones(len(made), bool)
        first, last = self.firsts(), ends - 1
        inner[first] = inner[last] = False
        made[first], made[last] = START, END
        made[inner] = np.where(known, self.words, np.uint64(UNKNOWN))[self.places]
        return made

    def firsts(self) -> np.ndarray:
        return np.cumsum(self.lengths + 2) - self.lengths - 2

    def pairs(self, line: np.ndarray) -> np.ndarray:
        """The bigram that ends at each word or end of text; the end of a text and the start of the next are none."""
        return np.delete(runs(line, 2), self.firsts()[1:] - 1)


def _sent(chunk: _Chunk, keys: np.ndarray, n: np.ndarray, target: np.ndarray, ranges: int, first: int = 0) -> Iterator[pa.RecordBatch]:
    """Sorted keys with counts, a row for each range of keys that they are in; ranges are numbered from `first`."""
    bounds = [0, *np.searchsorted(keys, np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)), len(keys)]
    for k in range(ranges):
        at = slice(bounds[k], bounds[k + 1])
        if at.start < at.stop:
            row = (first + k, chunk.id, at.stop - at.start, _keyed(keys[at]), _packed(n[at]), _packed(target[at]))
            yield _batch(_ASKED, [row])


def _answered(asked: DataFrame, ranges: int, least: int) -> DataFrame:
    """The totals of each row's keys over all rows of the range; once for a range, how many keys of it are kept."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list[tuple]] = {}
        for batch in batches:
            for part, chunk, _, keys, n, target in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                by_part.setdefault(part, []).append((chunk, _keys(keys), _unpacked(n), _unpacked(target)))
        for part, blocks in by_part.items():
            found, places = np.unique(np.concatenate([b[1] for b in blocks]), return_inverse=True)
            # Doubles hold these sums exactly.
            sums, targets = (
                np.bincount(places, np.concatenate([b[i] for b in blocks]), len(found)).astype(np.int64) for i in (2, 3)
            )
            kept = int((sums >= least).sum())
            at = 0
            for chunk, keys, _, _ in blocks:
                own = places[at : at + len(keys)]
                at += len(keys)
                yield _batch(_ANSWERS, [(chunk, part, _packed(sums[own]), _packed(targets[own]), kept)])
                kept = 0

    return asked.repartition(ranges, "part").mapInArrow(total, _ANSWERS)


def _kind(answers: pa.Table, kind: int) -> list[dict]:
    return sorted((r for r in answers.to_pylist() if r["kind"] == kind), key=lambda r: r["part"])


def _told(answers: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Totals of all keys of one kind that a chunk sent, in the order of its keys."""
    rows = _kind(answers, kind)
    n, target = ([_unpacked(r[c]) for r in rows] or [np.empty(0, np.int64)] for c in ("n", "n_target"))
    return np.concatenate(n), np.concatenate(target)


def _joined(chunks: DataFrame, answers: DataFrame, made: Callable[[_Chunk, pa.Table], pa.Table], schema: str) -> DataFrame:
    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        return made(_Chunk(left.to_pylist()[0]), right)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(each, schema)


def _losses(line: np.ndarray, first: np.ndarray, single: np.ndarray, pair: np.ndarray, whole: int, words: int, smoothing: Smoothing) -> np.ndarray:
    """The mean loss of each text, from the counts of all keys of the line and of the bigrams."""
    word = np.delete(single, first)
    before = np.delete(single, np.append(first[1:], len(line)) - 1)
    share = (word + smoothing.added) / (whole + smoothing.added * (words + 2))
    each = -np.log((pair + smoothing.backoff * share) / (before + smoothing.backoff))
    starts = first - np.arange(len(first))
    return np.add.reduceat(each, starts) / np.diff(np.append(starts, len(each)))


def _chosen(chunks: DataFrame, good: DataFrame) -> DataFrame:
    """chunk and the places of its documents that are among `good`."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, unnamed = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["unnamed"], np.uint8)
                at = np.flatnonzero(unnamed == 0)
                chunk = np.full(len(at), row["chunk"])
                yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(at), pa.array(ids[at])], names=["chunk", "place", "doc_id"])

    rows = chunks.select("chunk", "doc_ids", "unnamed").mapInArrow(placed, "chunk long, place long, doc_id long")
    return rows.join(good, "doc_id", "left_semi").groupBy("chunk").agg(F.collect_list("place").alias("places"))


def score_documents(
    docs: DataFrame, labels: DataFrame, smoothing: Smoothing = Smoothing(), least: int = LEAST, chunk_words: int = CHUNK
) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score for every row of `docs` (doc_id, text).

    Losses are means over the words and the end of a text, in nats; the score is the target's loss minus
    the background's, so the lower the more target-like.  The target are all labelled documents of good
    quality that are not toxic.
    Defined results for odd rows: a null or empty text has the loss of its end alone; labels with a null
    are left out; without labels the target model knows nothing but the vocabulary; repeated rows count
    and score as often as they stand; further columns are left out.
    """
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    good = labels.filter("quality = 1 and toxic = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    chunks = stored(whole.mapInArrow(lambda batches: _chunked(batches, chunk_words), _CHUNKS), "chunks")

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _Chunk(row)
                yield from _sent(chunk, chunk.words, chunk.times, np.zeros_like(chunk.times), ranges)

    words = stored(_answered(chunks.mapInArrow(ask_words, _ASKED), ranges, least), "words")
    vocabulary = words.agg(F.coalesce(F.sum("kept"), F.lit(0))).first()[0]
    none = F.array().cast("array<bigint>")
    answers = words.select("chunk", F.lit(0).alias("kind"), "part", "n", "n_target", none.alias("places"))
    empty = F.lit(None).cast("binary")
    targets = _chosen(chunks, good).select("chunk", F.lit(1), F.lit(0), empty, empty, "places")

    def ask_pairs(chunk: _Chunk, found: pa.Table) -> pa.Table:
        line = chunk.lines(_told(found, 0)[0] >= least)
        first = chunk.firsts()
        chosen = np.zeros(len(first), bool)
        for row in _kind(found, 1):
            chosen[row["places"]] = True
        target = np.repeat(chosen, chunk.lengths + 2)
        # The start is never predicted.
        predicted = np.delete(target, first)
        everything = np.full(len(predicted), ALL, np.uint64)
        sent = []
        for at, keys, of in (
            (0, np.concatenate((line, everything)), np.concatenate((target, predicted))),
            (ranges, chunk.pairs(line), predicted),
        ):
            own, places = np.unique(keys, return_inverse=True)
            n, t = (np.bincount(p, minlength=len(own)) for p in (places, places[of]))
            sent += _sent(chunk, own, n, t, ranges, at)
        return pa.Table.from_batches(sent)

    def score(chunk: _Chunk, found: pa.Table) -> pa.Table:
        line = chunk.lines(_told(found, 0)[0] >= least)
        first = chunk.firsts()
        keys, single = np.unique(np.append(line, np.uint64(ALL)), return_inverse=True)
        pair = np.unique(chunk.pairs(line), return_inverse=True)[1]
        losses = []
        for singles, pairs in zip(_told(found, 2), _told(found, 3), strict=True):
            everything = singles[np.searchsorted(keys, np.uint64(ALL))]
            losses.append(_losses(line, first, singles[single[:-1]], pairs[pair], everything, vocabulary, smoothing))
        made = [pa.array(chunk.doc_ids, mask=chunk.unnamed), pa.array(chunk.lengths + 1), losses[1], losses[0], losses[1] - losses[0]]
        return pa.table(made, names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    counted = _answered(_joined(chunks, answers.union(targets), ask_pairs, _ASKED), 2 * ranges, least)
    kind = F.when(F.col("part") < ranges, 2).otherwise(3)
    final = answers.union(counted.select("chunk", kind, "part", "n", "n_target", none))
    return _joined(chunks, final, score, _SCORES)
