"""Benchmark passages in a training corpus, by suffix arrays over shards of the corpus.

A shard is what a task gets at a time: some thousand whole documents.  Its suffix array holds the places
from which a passage could be matched; words that no benchmark item has end a match, so they cut the
shard into runs, and a run too short for the shortest window is left out.  Every suffix of every item is
searched in it by bisection, all at once; the neighbours of its place give its longest verbatim match,
and the interval of suffixes that share its first window gives every location of that window.

Documents are never shuffled and pass through once.  The benchmark is the query set: it is read in blocks
of a bounded size, each sent to all tasks; more blocks make a longer chain of narrow steps, not a larger
broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqimpact.llm.store import carried, quoted

WINDOW = 10
# Bytes of benchmark texts in a block; only a single longer text makes a larger one.
BLOCK_BYTES = 4 << 20

# Bytes of a text that belong to words, A-Z as a-z; all others separate words.
_AS_WORDS = bytes(
    c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c >= 0x80 else c + 32 if c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_AS_WORDS).split() if text else []


@dataclass
class Items:
    """The items of a block as one array of word numbers, each item followed by -1."""

    vocabulary: dict[bytes, int]
    names: list[str]
    tokens: np.ndarray
    starts: np.ndarray  # of the suffixes that are searched
    item: np.ndarray  # the item of each suffix
    window: np.ndarray  # the window of that item
    longest: int


def indexed(items: list[tuple[str, list[bytes]]]) -> Items:
    vocabulary: dict[bytes, int] = {}
    tokens: list[int] = []
    names, starts, item, window = [], [], [], []
    for name, words in items:
        size = min(WINDOW, len(words))
        for place in range(len(words)):
            starts.append(len(tokens) + place)
            item.append(len(names))
            window.append(size)
        tokens.extend(vocabulary.setdefault(word, len(vocabulary)) for word in words)
        tokens.append(-1)
        names.append(name)
    arrays = (np.array(x, np.int64) for x in (tokens, starts, item, window))
    return Items(vocabulary, names, *arrays, longest=max((len(words) for _, words in items), default=0))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of `text` that hold a word (0 or more), sorted by what follows them up to -1, to `depth` words.

    By prefix doubling: ranks by 1, 2, 4, ... words.
    """
    n = len(text)
    rank = text + 1
    step = 1
    while step < depth:
        ahead = np.zeros(n, np.int64)
        # A suffix that has ended has rank 0 from there on: ranks of places behind a -1 must not count.
        ahead[: n - step] = rank[step:]
        ended = _ends(text) - np.arange(n) <= step
        ahead[ended] = 0
        key = rank * (n + 2) + ahead
        order = np.argsort(key, kind="stable")
        changed = np.concatenate(([0], (np.diff(key[order]) != 0).astype(np.int64)))
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(changed)
        new += 1
        new[text < 0] = 0
        if new.max() == rank.max() and step > 1:
            rank = new
            break
        rank, step = new, 2 * step
    order = np.argsort(rank, kind="stable")
    return order[text[order] >= 0]


def _ends(text: np.ndarray) -> np.ndarray:
    """For each place the next -1."""
    n = len(text)
    marks = np.where(text < 0, np.arange(n), n)
    return np.minimum.accumulate(marks[::-1])[::-1]


def _compared(text: np.ndarray, at: np.ndarray, query: np.ndarray, q: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words in common (to `limit`) and the sign of text[at:] against query[q:]; 0 if equal that far."""
    common = np.zeros(len(q), np.int64)
    sign = np.zeros(len(q), np.int64)
    live = np.flatnonzero(limit > 0)
    while len(live):
        a, b = text[at[live] + common[live]], query[q[live] + common[live]]
        sign[live] = np.sign(a - b)
        go = (a == b) & (a >= 0)
        live = live[go]
        common[live] += 1
        live = live[common[live] < limit[live]]
    return common, sign


def _bisected(text, array, query, q, limit, upper: bool) -> np.ndarray:
    """The first place of the suffix array that is not below (or, for `upper`, is above) each query."""
    low, high = np.zeros(len(q), np.int64), np.full(len(q), len(array), np.int64)
    while True:
        live = np.flatnonzero(low < high)
        if not len(live):
            return low
        middle = (low[live] + high[live]) // 2
        _, sign = _compared(text, array[middle], query, q[live], limit[live])
        right = sign <= 0 if upper else sign < 0
        low[live[right]] = middle[right] + 1
        high[live[~right]] = middle[~right]


@dataclass
class Matches:
    """All occurrences of windows in a shard: document, first word in it, item, first word in the item, words."""

    doc: np.ndarray
    place: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    size: np.ndarray
    # The longest verbatim match of each suffix of the items.
    longest: np.ndarray


def search(documents: list[np.ndarray], items: Items) -> Matches:
    """`documents`: word numbers of the vocabulary of the items, -1 for other words."""
    none = np.empty(0, np.int64)
    longest = np.zeros(len(items.starts), np.int64)
    sizes = np.array([len(d) + 1 for d in documents], np.int64)
    whole = np.concatenate([x for d in documents for x in (d, [-1])]).astype(np.int64) if documents else none
    shortest = int(items.window.min()) if len(items.window) else 1
    # Runs of known words that can hold a window, each followed by its -1.
    n = len(whole)
    stops = np.flatnonzero(whole < 0)
    begins = np.concatenate(([0], stops[:-1] + 1)) if len(stops) else none
    lengths = stops - begins
    held = lengths >= max(shortest, 1)
    if not n or not held.any() or not len(items.starts):
        return Matches(none, none, none, none, none, longest)
    flags = np.zeros(n + 1, np.int64)
    np.add.at(flags, begins[held], 1)
    np.add.at(flags, stops[held] + 1, -1)
    origin = np.flatnonzero(np.cumsum(flags)[:n] > 0)
    text = whole[origin]
    array = suffix_array(text, items.longest)

    every = np.full(len(items.starts), items.longest + 1)
    place = _bisected(text, array, items.tokens, items.starts, every, False)
    for neighbour in (place - 1, place):
        inside = np.flatnonzero((neighbour >= 0) & (neighbour < len(array)))
        common, _ = _compared(text, array[neighbour[inside]], items.tokens, items.starts[inside], every[inside])
        longest[inside] = np.maximum(longest[inside], common)

    hit = np.flatnonzero(longest >= items.window)
    q, limit = items.starts[hit], items.window[hit]
    low = _bisected(text, array, items.tokens, q, limit, False)
    count = _bisected(text, array, items.tokens, q, limit, True) - low
    # Suffixes within the last words of an item hold no whole window: `longest` says so already.
    suffix = np.repeat(hit, count)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = origin[array[np.repeat(low, count) + inner]]
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    doc = np.searchsorted(first, at, side="right") - 1
    item = items.item[suffix]
    item_start = np.concatenate(([0], np.flatnonzero(items.tokens < 0)[:-1] + 1))
    return Matches(doc, at - first[doc], item, items.starts[suffix] - item_start[item], items.window[suffix], longest)


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(starts) - 1]))
    return starts[new].tolist(), ends[last].tolist()


def _longest_matches(m: Matches, at: np.ndarray, names: list[str]) -> list[dict]:
    """For each item found in one document its longest match: windows that follow each other are one."""
    order = np.lexsort((m.place[at], m.place[at] - m.offset[at], m.item[at]))
    item, place, offset, size = (x[at][order] for x in (m.item, m.place, m.offset, m.size))
    shift = place - offset
    new = np.concatenate(([True], (np.diff(item) != 0) | (np.diff(shift) != 0) | (np.diff(place) != 1)))
    begin = np.flatnonzero(new)
    end = np.concatenate((begin[1:], [len(item)])) - 1
    length = place[end] + size[end] - place[begin]
    best: dict[int, dict] = {}
    for b, words in zip(begin.tolist(), length.tolist(), strict=True):
        k = int(item[b])
        if k not in best or words > best[k]["words"]:
            best[k] = {"item_id": names[k], "words": words, "doc_word": int(place[b]), "item_word": int(offset[b])}
    return list(best.values())


MADE = ("n_words", "hit_starts", "hit_ends", "matches")
_MATCHES = pa.list_(
    pa.struct([("item_id", pa.string()), ("words", pa.int64()), ("doc_word", pa.int64()), ("item_word", pa.int64())])
)
_TYPES = (
    "n_words long, hit_starts array<long>, hit_ends array<long>, "
    "matches array<struct<item_id: string, words: long, doc_word: long, item_word: long>>"
)


def _with_block(
    docs: DataFrame, text: str, items: list[tuple[str, list[bytes]]], first: bool, drop: tuple[str, ...]
) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)
    given = [c for c in docs.columns if c not in MADE]
    carried = [c for c in given if c not in drop]
    place = given.index(text)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = indexed(sent.value)
        for batch in batches:
            documents, counts = [], []
            for value in batch.column(place):
                words = words_of(value.as_py())
                counts.append(len(words))
                documents.append(np.fromiter(map(known.vocabulary.get, words, repeat(-1)), np.int64, len(words)))
            m = search(documents, known)
            if first:
                starts, ends, matches = ([[] for _ in documents] for _ in range(3))
            else:
                starts, ends, matches = (batch.column(batch.schema.names.index(c)).to_pylist() for c in MADE[1:])
            order = np.argsort(m.doc, kind="stable")
            bounds = np.flatnonzero(np.diff(m.doc[order])) + 1
            for at in np.split(order, bounds) if len(order) else ():
                d = int(m.doc[at[0]])
                from_here = m.place[at]
                starts[d], ends[d] = _merged(
                    np.concatenate((np.array(starts[d], np.int64), from_here)),
                    np.concatenate((np.array(ends[d], np.int64), from_here + m.size[at])),
                )
                matches[d] = matches[d] + _longest_matches(m, at, known.names)
            lists = pa.list_(pa.int64())
            made = [pa.array(counts, pa.int64()), pa.array(starts, lists), pa.array(ends, lists), pa.array(matches, _MATCHES)]
            kept = [batch.column(batch.schema.names.index(c)) for c in carried]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*carried, *MADE])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in carried)
    return docs.select(*given, *([] if first else MADE)).mapInArrow(find, f"{kept}, {_TYPES}")


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string"))
    for name, text in named.filter("text is not null").toLocalIterator():
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((name, words_of(text)))
        size += len(text)
    yield block


def find_passages(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES, keep_text: bool = True
) -> DataFrame:
    """Add n_words, hit_starts, hit_ends and matches to every row of `docs`.

    hit_starts and hit_ends are the merged ranges of words inside an occurrence of a window; `matches` has
    for each item its longest verbatim match with its place in the document and in the item.  Defined
    results for odd rows: a null or empty text has no words and no hit; an item without words matches
    nothing; an item_id of null counts as an empty one; repeated documents are judged row by row and
    repeated items are one in the lists of ids; other columns are carried along, those named like a result, in
    any case, are replaced.  A text in a column named like a result is left out too.
    """
    own = carried(docs, MADE)
    name = next((name for name, c in own.items() if c.lower() == text.lower()), "text")
    keep_text = keep_text and name in own
    found = docs.select(
        *[F.col(quoted(c)).alias(plain) for plain, c in own.items()],
        *([] if name in own else [F.col(quoted(text)).alias(name)]),
    )
    first = True
    blocks = _blocks(benchmark, block_bytes)
    items = next(blocks)
    for later in blocks:
        found, first, items = _with_block(found, name, items, first, ()), False, later
    found = _with_block(found, name, items, first, () if keep_text else (name,))
    return found.select(*[F.col(plain).alias(c) for plain, c in own.items() if keep_text or plain != name], *MADE)


def contamination(found: DataFrame) -> DataFrame:
    """n_hit, item_ids (sorted as strings) and contaminated beside the columns of find_passages."""
    hit = F.aggregate(F.zip_with("hit_ends", "hit_starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda t, x: t + x)
    ids = F.sort_array(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.withColumns({"n_hit": hit, "item_ids": ids, "contaminated": F.size("hit_starts") > 0})


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` that hold no window of the benchmark, with their own columns."""
    own = carried(docs, ())
    apart = docs.select(*[F.col(quoted(c)).alias(name) for name, c in own.items()])
    name = next(name for name, c in own.items() if c.lower() == text.lower())
    judged = find_passages(apart, benchmark, name).filter(F.size("hit_starts") == 0)
    return judged.select(*[F.col(name).alias(c) for name, c in own.items()])
