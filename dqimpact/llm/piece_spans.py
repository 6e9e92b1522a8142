"""Subword pieces of texts with the bytes of the original text that each piece stands for.

A text is brought to the model's normal form first.  The model file carries a compiled character map (a
double-array trie over UTF-8); at each place the longest key that fits is replaced, and every byte of the
result remembers the offset in the original text that it came from.  White space is then collapsed,
escaped and put in front as the model asks, always together with these offsets.  Pieces cover runs of
normalised bytes, so a piece's first and next byte give its span in the original text.

No piece of such a model reaches from other characters over into a blank mark, so a text falls into
segments that are encoded on their own; a task encodes each different segment once.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Segments that a task remembers, and the longest one worth it, in characters.
REMEMBERED = 200_000
LONGEST = 64
# Bytes of text that a task encodes at a time.
BATCH_BYTES = 1 << 20

MARK = "▁"
SPANS = "doc_id long, ids array<int>, begins array<int>, ends array<int>, n_bytes int"


class CharacterMap:
    """A compiled character map: the size of a trie as four bytes, the trie, replacements that end in a zero.

    A cell of the trie holds the byte it stands for, where the cells after it lie, and whether a key ends.
    """

    def __init__(self, compiled: bytes) -> None:
        size = int.from_bytes(compiled[:4], "little")
        self.cells = memoryview(compiled[4 : 4 + size]).cast("I") if size else memoryview(b"\0\0\0\0").cast("I")
        self.values = compiled[4 + size :]
        self.alone: set[str] = set()
        self.firsts: set[str] = set()
        self.seconds: set[str] = set()
        self._survey()

    def _base(self, place: int) -> int:
        cell = self.cells[place]
        return place ^ (cell >> 10) << ((cell & 1 << 9) >> 6)

    def _after(self, bases: np.ndarray, letters: np.ndarray) -> list[tuple[int, int, int]]:
        """(number of the base, byte, place) of every cell that follows one of the bases."""
        cells = np.frombuffer(self.cells, "<u4")
        places = bases[:, None] ^ letters[None, :]
        label = cells[np.minimum(places, len(cells) - 1)] & np.uint32(0x800000FF)
        rows, columns = np.nonzero((label == letters[None, :]) & (places < len(cells)))
        return list(zip(rows.tolist(), letters[columns].tolist(), places[rows, columns].tolist(), strict=True))

    def _survey(self) -> None:
        """Find the characters that are keys, that begin longer ones, and ASCII characters that come second."""
        letters = np.arange(1, 256)
        level = [(b"", self._base(0))]
        while level:
            deeper = []
            for row, byte, place in self._after(np.array([base for _, base in level]), letters):
                key, base = level[row][0] + bytes([byte]), self._base(place)
                if len(key) < (1 if key[0] < 0xC0 else 2 if key[0] < 0xE0 else 3 if key[0] < 0xF0 else 4):
                    deeper.append((key, base))
                    continue
                if self.cells[place] >> 8 & 1:
                    self.alone.add(key.decode())
                following = self._after(np.array([base]), letters)
                if following:
                    self.firsts.add(key.decode())
                    self.seconds.update(chr(b) for _, b, _ in following if b < 0x80)
            level = deeper

    def longest(self, text: str, at: int) -> tuple[int, str] | None:
        """The number of characters of the longest key at this place, and its replacement."""
        found, base = None, self._base(0)
        for i in range(at, len(text)):
            for byte in text[i].encode():
                place = base ^ byte
                if not byte or place >= len(self.cells) or self.cells[place] & 0x800000FF != byte:
                    return found
                base = self._base(place)
            if self.cells[place] >> 8 & 1:
                start = self.cells[base] & 0x7FFFFFFF
                found = i + 1 - at, self.values[start : self.values.index(b"\0", start)].decode()
        return found


def _any_of(characters: set[str]) -> str:
    return "[" + "".join(map(re.escape, sorted(characters))) + "]"


@dataclass
class Normal:
    """A text in normal form: its bytes, and for each byte, and the end, the offset it came from."""

    data: bytes
    origin: np.ndarray


class Normaliser:
    """Longest-prefix replacement and treatment of white space, with offsets."""

    def __init__(
        self,
        mapping: CharacterMap,
        protected: tuple[str, ...] = (),
        add_prefix: bool = True,
        collapse: bool = True,
        escape: bool = True,
        at_end: bool = False,
    ) -> None:
        if re.search(rb"[^\0 ][^\0]*  ", mapping.values):
            raise ValueError("a replacement holds two blanks in a row")
        self.mapping, self.protected = mapping, sorted(protected, key=len, reverse=True)
        self.add_prefix, self.collapse, self.at_end = add_prefix, collapse, at_end
        self.blank = MARK if escape else " "
        places = [re.escape(p) for p in self.protected]
        if mapping.alone:
            places.append(_any_of(mapping.alone))
        if mapping.firsts:
            seconds = "".join(map(re.escape, sorted(mapping.seconds)))
            places.append(rf"{_any_of(mapping.firsts)}(?=[{seconds}\x80-\U0010ffff])")
        # Where a key may begin; all other characters stay as they are.
        self.candidate = re.compile("|".join(places)) if places else None

    def _fitting(self, text: str, at: int) -> tuple[int, str] | None:
        """Characters of the key at this place, and what it becomes; what is protected goes first."""
        for own in self.protected:
            if text.startswith(own, at):
                return len(own), own
        return self.mapping.longest(text, at)

    def _mapped(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Bytes after replacement, and their origins with the end's."""
        whole = text.encode()
        if self.candidate is None:
            return np.frombuffer(whole, np.uint8), np.arange(len(whole) + 1)
        made, origins, at, byte = [], [], 0, 0

        def keep(upto: int) -> int:
            same = text[at:upto].encode()
            made.append(same)
            origins.append(np.arange(byte, byte + len(same)))
            return byte + len(same)

        match = self.candidate.search(text)
        while match:
            fitting = self._fitting(text, match.start())
            if fitting is None:
                match = self.candidate.search(text, match.start() + 1)
                continue
            byte = keep(match.start())
            length, value = fitting
            made.append(value.encode())
            origins.append(np.full(len(made[-1]), byte))
            at = match.start() + length
            byte += len(text[match.start() : at].encode())
            match = self.candidate.search(text, at)
        keep(len(text))
        return np.frombuffer(b"".join(made), np.uint8), np.concatenate([*origins, [len(whole)]])

    def _leading(self, text: str) -> tuple[int, bool]:
        """Bytes of blanks in front, and whether there is nothing else."""
        at = 0
        while at < len(text):
            length, value = (self._fitting(text, at) if self.candidate else None) or (1, text[at])
            if value != " ":
                return len(text[:at].encode()), False
            at += length
        return len(text.encode()), True

    def __call__(self, text: str) -> Normal:
        if not text:
            return Normal(b"", np.zeros(1, np.int64))
        start = 0
        if self.collapse:
            start, empty = self._leading(text)
            if empty:
                return Normal(b"", np.array([start]))
        data, origin = self._mapped(text)
        end, origin = origin[-1:], origin[:-1]
        if self.collapse and len(data):
            blank = data == 32
            kept = ~(blank & np.concatenate(([True], blank[:-1])))
            data, origin = data[kept], origin[kept]
        wide = len(self.blank.encode())
        if wide > 1:
            origin = np.repeat(origin, np.where(data == 32, wide, 1))
        made = data.tobytes().replace(b" ", self.blank.encode())
        if self.add_prefix and not self.at_end:
            made = self.blank.encode() + made
            origin = np.concatenate((np.full(wide, start), origin))
        while self.collapse and made.endswith(self.blank.encode()):
            made = made[:-wide]
            end, origin = origin[len(made) :][:1], origin[: len(made)]
        if self.add_prefix and self.at_end:
            made += self.blank.encode()
            origin = np.concatenate((origin, np.full(wide, end[0])))
        return Normal(made, np.concatenate((origin, end)))


class _Segments(dict):
    """Ids of the segments met first, up to a bound; those of the present texts stand beside them."""

    fresh: dict[str, bytes] = {}

    def __missing__(self, segment: str) -> bytes:
        return self.fresh[segment]

    def learn(self, segments: list[str], ids: list[list[int]]) -> None:
        self.fresh = {}
        for segment, found in zip(segments, ids, strict=True):
            known = self if len(self) < REMEMBERED and len(segment) <= LONGEST else self.fresh
            known[segment] = array("i", found).tobytes()


class SpanEncoder:
    """Encodes texts with one model file, inside one task."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec, kinds = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        own = [p.piece for p in model.pieces if p.type == kinds.USER_DEFINED]
        self.normalise = Normaliser(
            CharacterMap(spec.precompiled_charsmap), tuple(own), spec.add_dummy_prefix,
            spec.remove_extra_whitespaces, spec.escape_whitespaces, model.trainer_spec.treat_whitespace_as_suffix,
        )
        self.original = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        # Segments are in normal form already.
        spec.Clear()
        spec.name, spec.add_dummy_prefix, spec.remove_extra_whitespaces = "identity", False, False
        spec.escape_whitespaces = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())

        # Bytes that a piece stands for; byte pieces and the unknown one depend on what is around them.
        self.sizes = np.array([len(p.piece.encode()) for p in model.pieces], np.int64)
        self.byte = np.array([int(p.piece[1:-1], 16) if p.type == kinds.BYTE else -1 for p in model.pieces])
        pieces = [p.piece for p in model.pieces]
        apart = not own and not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        bytewise = model.trainer_spec.byte_fallback
        if apart and bytewise and not any("\n" in p for p in pieces):
            self.cut = re.compile(rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        elif apart and (bytewise or MARK in pieces):
            self.cut = re.compile(rf"{MARK}*[^{MARK}]+|{MARK}+")
        else:
            self.cut = None
        self.known = _Segments()

    def _lengths(self, ids: np.ndarray, normal: Normal) -> np.ndarray:
        """Normalised bytes under each piece; those of a character spelled by its bytes count for the last one."""
        if self.plain.unk_id() in ids:
            found = self.plain.encode(normal.data.decode(), return_type="proto").pieces
            return np.array([p.end - p.begin for p in found], np.int64)
        lengths, byte = self.sizes[ids], self.byte[ids]
        spelled = byte >= 0
        if spelled.any():
            later = spelled & (byte >= 0x80) & (byte < 0xC0)
            at = np.arange(len(ids))
            first = np.maximum.accumulate(np.where(spelled & ~later, at, 0))
            last = ~np.concatenate((later[1:], [False]))
            lengths = np.where(spelled, np.where(last, at - first + 1, 0), lengths)
        return lengths

    def __call__(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its ids, and the first byte and the byte after the last one of each piece."""
        normals = [self.normalise(text) for text in texts]
        wholes = [normal.data.decode() for normal in normals]
        segments = [[w] for w in wholes] if self.cut is None else [self.cut.findall(w) for w in wholes]
        new = list(set(chain.from_iterable(segments)).difference(self.known))
        self.known.learn(new, self.plain.encode(new, num_threads=1) if new else [])
        for normal, parts in zip(normals, segments, strict=True):
            ids = np.frombuffer(b"".join(map(self.known.__getitem__, parts)), np.int32)
            lengths = self._lengths(ids, normal)
            ends = np.cumsum(lengths)
            begins = normal.origin[ends - lengths]
            yield ids, begins, np.where(lengths > 0, normal.origin[ends], begins)


def encode_spans(docs: DataFrame, model: str, text: str = "text", marks: bool = True) -> DataFrame:
    """doc_id, ids, begins, ends, n_bytes for every row: the pieces and their bytes [begin, end) of the text.

    `marks` puts the model's begin and end ids around the pieces, with empty spans at both ends of the
    text.  Where a character is spelled by its bytes, the last of these pieces has its span and the
    others an empty one.  Defined results for odd rows: a null text counts as empty and has the two marks
    alone; rows that share a doc_id, or have none, are encoded one by one; further columns are left out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def made(numbers: pa.Array, found: list, sizes: np.ndarray) -> pa.RecordBatch:
        counts = np.array([len(ids) for ids, _, _ in found], np.int64)
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
        columns = [
            pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[k] for f in found]).astype(np.int32)))
            for k in range(3)
        ]
        return pa.RecordBatch.from_arrays(
            [numbers, *columns, pa.array(sizes, pa.int32())],
            names=["doc_id", "ids", "begins", "ends", "n_bytes"],
        )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = SpanEncoder(model)
        first, last = encoder.original.bos_id(), encoder.original.eos_id()
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            if not batch.num_rows:
                continue
            groups = np.cumsum(sizes, dtype=np.int64) // BATCH_BYTES
            for group in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(groups)) + 1):
                part = batch.slice(int(group[0]), len(group))
                found = []
                for row, size in zip(encoder([t or "" for t in part.column(1).to_pylist()]), sizes[group], strict=True):
                    if marks:
                        around = ((first, last), (0, size), (0, size))
                        row = tuple(np.concatenate(([a], x, [b])) for x, (a, b) in zip(row, around, strict=True))
                    found.append(row)
                yield made(part.column(0), found, sizes[group])

    return rows.mapInArrow(encode, SPANS)


def decode_digests(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the text that the model decodes them to, span_bytes.

    span_bytes counts the bytes of the text that lie in spans.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            lists, spans = batch.column(1), pc.subtract(batch.column(3).flatten(), batch.column(2).flatten())
            values = lists.flatten().to_numpy(zero_copy_only=False)
            covered = np.concatenate(([0], np.cumsum(spans.to_numpy(zero_copy_only=False), dtype=np.int64)))
            counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(counts)
            rows = []
            for a, b in zip(ends - counts, ends, strict=True):
                ids = values[a:b]
                text = processor.decode(ids.tolist()) if len(ids) else ""
                rows.append((hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            of_ids, of_texts = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(counts), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string()),
                    pa.array(covered[ends] - covered[ends - counts]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "span_bytes"],
            )

    return encoded.mapInArrow(
        digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long"
    )
