"""Token ids of documents in ORC files, and documents read back from them.

The rows are dealt by ranges of doc_id and sorted, so that the files hold ascending ids: stripes can be
read side by side, row indexes and Bloom filters on doc_id let a reader skip what it does not look for,
and the ids are stored with the format's run-length encoding of integers.  A file row holds the place of
the document inside its range; a small table of range totals, one row for each range, turns it into the
place in the whole corpus.

A token never reaches over white space with this kind of tokenizer, so a task encodes each different
word once and puts texts together from what it knows; `by_words=False` encodes whole texts, for
tokenizers of which this does not hold.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

END_ID = 2
# Words, and pieces of words, whose ids a task remembers: the first it meets.
REMEMBERED = 450_000


@dataclass(frozen=True)
class OrcLayout:
    """How the files are laid out."""

    stripe_bytes: int = 64 << 20
    index_stride: int = 1_000
    bloom_fpp: float = 0.01
    compress: str = "zlib"

    def options(self) -> dict[str, str]:
        return {
            "orc.stripe.size": str(self.stripe_bytes),
            "orc.row.index.stride": str(self.index_stride),
            "orc.create.index": "true",
            "orc.bloom.filter.columns": "doc_id",
            "orc.bloom.filter.fpp": str(self.bloom_fpp),
            "compression": self.compress,
        }


# Words of these characters alone are split as the tokenizer splits them: runs of letters, single digits,
# runs of other marks.  Words with an apostrophe, a special token or other characters are left to it whole.
_PLAIN = re.compile(r"(?!.*<\|)[!-&(-~à-öø-ÿ]+", re.S)
_PIECES = re.compile(r"[a-zà-öø-ÿ]+|[0-9]|[^a-z0-9à-öø-ÿ]+")


# What a tokenizer file says where words end at white space and are split in this way.
WORDS_END_AT_SPACE = {
    "truncation": None,
    "padding": None,
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


def words_end_at_space(path: str) -> bool:
    """Whether the tokenizer file is one whose ids are those of its words, split as the word path splits them."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    same = all(told.get(part) == value for part, value in WORDS_END_AT_SPACE.items())
    added = all(token["content"].startswith("<|") and " " not in token["content"] for token in told.get("added_tokens") or ())
    return same and added and told["model"]["type"] == "BPE" and not told["model"].get("dropout")


def _byte_characters() -> dict[int, str]:
    """Letters beyond ASCII as a byte-level model has them: a character for each byte of UTF-8.

    Printable bytes stand for themselves, the others for the characters from 256 on, in order.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    character = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    return {c: "".join(character[b] for b in chr(c).encode()) for c in range(0xA1, 0x100)}


class Remembered(dict):
    """Values made at the first request; the first ones stay, up to a bound."""

    def __init__(self, make: Callable) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < REMEMBERED:
            self[key] = value
        return value


def word_encoder(path: str, by_words: bool = True) -> Callable[[list[str]], list[np.ndarray]]:
    """A function from texts to their ids, for use inside one task.

    What it remembers are words as they stand in texts and the pieces that they are made of, so that a
    word met for the first time mostly is put together from known pieces.  Only tokenizers whose file tells
    that their words end at white space are treated so; texts go to all others whole.
    """
    # A task has one core; threads of its own would only cost memory.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    def whole(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    def of_piece(piece: str) -> bytes:
        spelled = piece if piece.isascii() else piece.translate(as_bytes)
        return array("i", [token.id for token in model.tokenize(spelled)]).tobytes()

    def of_word(word: bytes) -> bytes:
        text = word.decode()
        lower = text.lower()
        if _PLAIN.fullmatch(lower):
            return b"".join(map(pieces.__getitem__, _PIECES.findall(lower)))
        return array("i", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(texts: list[str]) -> list[np.ndarray]:
        known = words.__getitem__
        return [np.frombuffer(b"".join(map(known, text.encode().split())), np.int32) for text in texts]

    # This code travels by value and is new in every task; what a worker process has learned stays with
    # the library, which is not.
    kept = tokenizers.__dict__.setdefault("_remembered", {})
    if path not in kept:
        tokenizer = tokenizers.Tokenizer.from_file(path)
        model, as_bytes = tokenizer.model, _byte_characters()
        pieces, words = Remembered(of_piece), Remembered(of_word)
        kept[path] = whole, encode if words_end_at_space(path) else whole
    whole, encode = kept[path]
    return encode if by_words else whole


def _groups(batch: pa.RecordBatch, size: int = 200) -> Iterator[list[str]]:
    texts = batch.column(1)
    for start in range(0, batch.num_rows, size):
        yield [text or "" for text in texts.slice(start, size).to_pylist()]


def encoded(docs: DataFrame, tokenizer: str, end_id: int = END_ID, by_words: bool = True) -> DataFrame:
    """shard, doc_id, start (inside the shard), n_tokens, token_ids; sorted by doc_id in every shard.

    Defined results for odd rows: a null or empty text has the end id alone; rows that share a doc_id
    stand side by side, in the order of their texts; rows without doc_id come first; further columns are left
    out.
    """
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = placed.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    placed = placed.select("doc_id", "text", F.spark_partition_id().alias("shard"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = word_encoder(tokenizer, by_words)
        start = 0
        for batch in batches:
            done = 0
            for texts in _groups(batch):
                ids = [np.append(found, np.int32(end_id)) for found in encode_texts(texts)]
                sizes = np.array([len(x) for x in ids], np.int64)
                ends = np.cumsum(sizes)
                offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(2).slice(done, len(texts)),
                        batch.column(0).slice(done, len(texts)),
                        pa.array(start + ends - sizes),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids))),
                    ],
                    names=["shard", "doc_id", "start", "n_tokens", "token_ids"],
                )
                start += int(ends[-1])
                done += len(texts)

    return placed.mapInArrow(encode, "shard int, doc_id long, start long, n_tokens long, token_ids array<int>")


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, layout: OrcLayout = OrcLayout()
) -> None:
    encoded(docs, tokenizer, end_id).write.options(**layout.options()).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, token_ids."""
    files = spark.read.schema("shard int, doc_id long, start long, n_tokens long, token_ids array<int>").orc(path)
    # One row for each range of the writer; the shards are numbered in the order of their ids.
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return files.join(F.broadcast(bases), "shard").select(
        "doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "token_ids"
    )


def checksums(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
            starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
            counts = pa.array((ends - starts).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), counts, pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return read.mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
