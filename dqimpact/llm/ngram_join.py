"""Self-join of documents on the Jaccard similarity of their word n-grams, with adaptive prefixes.

The n-grams of all documents have one global order, rare ones first.  Two sets that share `t` members
must share at least `l` of the first `size - t + l` members of each, for every l.  A document picks its
own l, its level: a longer prefix costs more list entries, but a partner must then meet it more often
before the pair is verified.  The estimate of both costs comes from counts of all n-grams of the corpus,
held in a fixed number of buckets; it steers the work and never the result.  The smaller set of a pair
must have most of its members in common with any larger one, so its prefix may be shorter still.  A pair
is verified when it shares so many prefix members that the rest could make up for what is missing: the
lower of the two levels at least, and more for sets of like size.

Documents with equal sets fall into one class first.  Then links are sought where they are cheap: each
class is held against two leaders, the class of highest degree among its lists and one picked by a draw,
and the components of the links found are labelled.  A list whose members are all in one component needs no more work.  For the others
every pair of members from different components that shares enough is verified, so that no link between
components is lost.  Links inside a component are not sought; `ngram_links` finds all of them.
Entries go early: those that fit no other one of their list by size, and nodes that are left with fewer
entries than any partner would share.  A pair is told once, at the first entry that it has in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dqimpact.llm.components import components
from dqimpact.llm.hashed import WordHashes, hashed_counts, mixed, runs
from dqimpact.llm.store import stored

# Buckets of the corpus counts (16 MB as one byte each) and of the map of active classes.
COUNT_BITS = 24
ACTIVE_BITS = 24
# The longest prefix extension that a document may choose, and the cost of one verification in list entries.
LEVELS = 8
VERIFY_COST = 20.0
# Entries of a list that one task may get before the list is salted.
HOT_LIST = 5_000
# Documents whose prefixes a task hands on at a time.
BATCH_DOCS = 1_000
# Up to so many entries a node's tokens travel with each of them.
NARROW = 64
# Bits of the place in a prefix, below the class of frequency.
RANK_BITS = 40


def shingle_set(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct n-gram hashes of a text; a shorter text is one n-gram, an empty one has none."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    known = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    return np.unique(runs(known, min(width, len(words))))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple]:
    ids, texts = batch.column(0), batch.column(1)
    for i in range(batch.num_rows):
        yield ids[i].as_py(), texts[i].as_py()


def _classes(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, and a digest of the set, its first 64 bits apart as the name of the class."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, keys, digests = [], [], []
            for _, text in _texts(batch):
                found = shingle_set(text, width, hashes)
                digest = xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None
                sizes.append(len(found))
                keys.append(int.from_bytes(digest[:8], "little", signed=True) if digest else None)
                digests.append(digest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(digests, pa.binary())],
                names=["doc_id", "n", "key", "digest"],
            )

    return docs.mapInArrow(digests, "doc_id long, n long, key long, digest binary")


def _log_class(counts: np.ndarray) -> np.ndarray:
    """A count as one byte, in steps of a fifth."""
    return np.minimum(np.round(4 * np.log2(1.0 + counts)), 255).astype(np.uint8)


def _corpus_counts(docs: DataFrame, width: int) -> np.ndarray:
    def found(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        hashes = WordHashes()
        for _, text in _texts(batch):
            yield shingle_set(text, width, hashes)

    return hashed_counts(docs, found, COUNT_BITS, _log_class)


def _needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _postings(docs: DataFrame, width: int, percent: int, counts: np.ndarray) -> DataFrame:
    """token, salt, key, n, level, rank: the prefix of every class, at least once for each task that holds it.

    `rank` has the token's class of frequency above its place in the prefix, which counts from 0.
    """
    decoded = np.exp2(np.arange(256) / 4.0) - 1.0
    # What other n-grams add to a bucket on average is no sign of a frequent one.
    floor = float(decoded[counts].mean())
    floor += 3 * floor**0.5
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, at = WordHashes(), shared.value
        excess = np.maximum(decoded - floor, 0.0)
        seen: set[int] = set()
        for batch in (b.slice(at, BATCH_DOCS) for b in batches for at in range(0, b.num_rows, BATCH_DOCS)):
            parts: list[list[np.ndarray]] = [[] for _ in range(6)]
            for _, text in _texts(batch):
                found = shingle_set(text, width, hashes)
                n = len(found)
                if not n:
                    continue
                key = int.from_bytes(xxhash.xxh3_128_digest(found.tobytes())[:8], "little", signed=True)
                if key in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(key)
                frequency = at[(found >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
                order = np.argsort(frequency, kind="stable")
                base, most = n - _needed(n, percent), min(LEVELS, _needed(n, percent))
                order = order[: base + most]
                entries = excess[frequency[order]]
                scanned = np.cumsum(entries)[base:] + 0.01 * np.arange(base + 1, base + most + 1)
                level = 1 + int(np.argmin(scanned * (1.0 + VERIFY_COST / np.arange(1, most + 1))))
                order, entries = order[: base + level], entries[: base + level]
                tokens = found[order].view(np.int64)
                spread = (entries // HOT_LIST).astype(np.int64)
                salt = (key & 0xFFFFFFFF) % (spread + 1) + (spread > 0)
                rank = (frequency[order].astype(np.int64) << RANK_BITS) + np.arange(len(tokens))
                row = (tokens, salt, key, n, level, rank)
                for made, value in zip(parts, row, strict=True):
                    made.append(value if isinstance(value, np.ndarray) else np.full(len(tokens), value, np.int64))
            if parts[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(p)) for p in parts],
                    names=["token", "salt", "key", "n", "level", "rank"],
                )

    return docs.mapInArrow(prefixes, "token long, salt long, key long, n long, level long, rank long")


def _shared_lists(postings: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """token, node, twice, n, level, rank, mates: entries in lists that hold another class of a fitting size.

    In the order of sizes the neighbours of an entry are the likeliest to fit.  `mates` is the lowest level
    in the list.  A salted list (salt 1 or more) is known to be long, and all its entries are kept.
    """
    once = (
        postings.repartition("token", "salt")
        .groupBy("token", "salt", "key")
        .agg(*[F.first(c).alias(c) for c in ("n", "level", "rank")])
    )
    sizes = Window.partitionBy("token", "salt").orderBy("n", "key")
    n, smaller, larger = F.col("n"), F.lag("n").over(sizes), F.lead("n").over(sizes)
    fits = (smaller.isNotNull() & _fits(smaller, n, percent)) | (larger.isNotNull() & _fits(n, larger, percent))
    lowest = F.min("level").over(Window.partitionBy("token", "salt"))
    kept = once.withColumns({"_fits": fits, "mates": F.when(F.col("salt") > 0, F.lit(1)).otherwise(lowest)})
    kept = kept.filter("salt > 0 or _fits").select("token", "key", "n", "level", "rank", "mates")
    return kept.join(classes, "key").select("token", "node", "twice", "n", "level", "rank", "mates")


def _sets(docs: DataFrame, width: int, active: DataFrame) -> DataFrame:
    """node, hashes of the classes in `active`; a few others may be among them."""

    def ids(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield mixed(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))

    flags = hashed_counts(active.select("node"), ids, ACTIVE_BITS, lambda c: (c > 0).astype(np.uint8))
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(flags))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, flags = WordHashes(), np.unpackbits(shared.value)
        for batch in batches:
            numbers = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            places = (mixed(numbers.view(np.uint64)) >> np.uint64(64 - ACTIVE_BITS)).astype(np.int64)
            wanted = np.flatnonzero(flags[places])
            texts = batch.column(1)
            found = [shingle_set(texts[int(i)].as_py(), width, hashes).tobytes() for i in wanted]
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers[wanted]), pa.array(found, pa.large_binary()).cast(pa.binary())], names=["node", "hashes"]
            )

    return docs.filter("doc_id is not null").mapInArrow(made, "node long, hashes binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the similarity, by the size of the intersection of the whole sets."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i in range(batch.num_rows):
                left, right = (np.frombuffer(batch.column(k)[i].as_py(), np.uint64) for k in (2, 3))
                both = np.concatenate((left, right))
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                kept.append(100 * common >= percent * (len(both) - common))
            keep = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"]
            )

    first = sets.select(F.col("node").alias("a"), F.col("hashes").alias("left"))
    second = sets.select(F.col("node").alias("b"), F.col("hashes").alias("right"))
    met = pairs.select("a", "b").join(first, "a").join(second, "b").select("a", "b", "left", "right")
    return met.mapInArrow(alike, "a long, b long")


def _fits(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can reach the similarity at all."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _star_pairs(lists: DataFrame, rank: Column, percent: int) -> DataFrame:
    """For each node the leader that it meets most often; the leader of a list ranks highest in it."""
    leader = lists.groupBy("token").agg(F.max(F.struct(rank.alias("r"), "node", "n", "component")).alias("led"))
    met = lists.join(leader, "token").filter(
        (F.col("node") != F.col("led.node"))
        & (F.col("component") != F.col("led.component"))
        & _fits(F.col("n"), F.col("led.n"), percent)
    )
    counted = met.groupBy("node", F.col("led.node").alias("leader")).agg(F.count(F.lit(1)).alias("times"))
    best = counted.groupBy("node").agg(F.max(F.struct("times", "leader")).alias("best"))
    return best.select(F.col("node").alias("a"), F.col("best.leader").alias("b"))


def _at_least(part: Column, whole: int, percent: int) -> Column:
    """part * percent / whole, rounded up."""
    return F.floor((part * percent + (whole - 1)) / whole)


def _with_bounds(lists: DataFrame, percent: int) -> DataFrame:
    """Add degree, end and cap of each node to its entries.

    `end` is the node's last entry in the global order.  Members up to there that stand in no list are in
    no other prefix; a partner whose entries end no earlier lacks all of them, and can be linked only if
    its size is `cap` at most.
    """
    place = F.col("rank").bitwiseAND(F.lit((1 << RANK_BITS) - 1))
    # Tokens are unsigned; with the first bit turned they are in order as signed numbers.
    order = F.struct(F.shiftright("rank", RANK_BITS).alias("c"), F.col("token").bitwiseXOR(F.lit(-(1 << 63))).alias("t"))
    nodes = lists.groupBy("node").agg(
        F.count(F.lit(1)).alias("degree"), F.max(order).alias("end"), F.max(place).alias("_place"),
        F.max("n").alias("_n"), F.max("twice").alias("_twice"), F.least(F.min("level"), F.min("mates")).alias("_least"),
    )
    # A pair shares as many entries as the lower of its levels, so who has fewer has no partner.
    nodes = nodes.filter(F.col("_twice") | (F.col("degree") >= F.col("_least")))
    alone = F.when(F.col("_twice"), 0).otherwise(F.greatest(F.col("_place") + 1 - F.col("degree"), F.lit(0)))
    cap = F.floor((F.col("_n") - alone) * (100 + percent) / percent) - F.col("_n")
    cap = F.when(F.col("_twice"), F.lit((1 << 62))).otherwise(cap)
    bounds = nodes.select("node", "degree", "end", cap.cast("long").alias("cap"))
    return lists.withColumn("place", place).drop("rank", "twice", "mates").join(bounds, "node")


def _cross_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs from different components that share enough of their prefixes; a is the smaller set.

    A set of n members has in common with a larger one, if they are linked, at least 2p / (100 + p) of
    its n members, and with a smaller one p / 100 of them.  What lies behind a prefix bounds what the
    prefixes may lack in common.  Before members of a list meet, those go that fit no other member of it
    by size, and lists that are then left with one component.
    """
    both = 100 + percent
    order = Window.partitionBy("token")
    up = order.orderBy("end").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = order.orderBy(F.desc("end")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fits = (F.min("n").over(down) <= F.col("cap")) | (F.col("n") <= F.max("cap").over(up))
    lists = lists.withColumn("_fits", fits).filter("_fits").drop("_fits")
    # The component with most entries in a list never meets itself there.
    sizes = lists.groupBy("token", "component").agg(F.count(F.lit(1)).alias("m"))
    spread = sizes.groupBy("token").agg(
        F.max(F.struct("m", "component"))["component"].alias("_main"), F.count(F.lit(1)).alias("_parts")
    )
    lists = lists.join(spread.filter("_parts > 1"), "token")
    lists = stored(lists.withColumn("main", F.col("component") == F.col("_main")).drop("_main", "_parts"), "open")

    # The smaller set of a pair is asked for the first part of its prefix only.
    rest = _at_least(2 * F.col("n"), both, percent) - F.col("level")
    asked = F.col("place") < F.col("n") - rest
    narrow = lists.groupBy("node").agg(
        F.array_sort(F.collect_set(F.when(asked, F.col("token")))).alias("asked"),
        F.array_sort(F.collect_set("token")).alias("held"),
        ((F.count(F.lit(1)) <= NARROW) & (F.min("n") == F.max("n"))).alias("_narrow"),
    )
    lists = lists.join(narrow.filter("_narrow").drop("_narrow"), "node", "left")
    small = lists.withColumn("rest", rest).filter(asked).withColumn("tokens", F.col("asked"))
    large = lists.withColumn("rest", _at_least(F.col("n"), 100, percent) - F.col("level")).withColumn("tokens", F.col("held"))
    names = ("node", "component", "main", "n", "rest", "end", "cap", "tokens")
    left = small.select("token", *[F.col(c).alias(f"{c}_a") for c in names])
    right = large.select("token", *[F.col(c).alias(f"{c}_b") for c in names])

    a, b = F.col("n_a"), F.col("n_b")
    ordered = (a < b) | ((a == b) & (F.col("node_a") < F.col("node_b")))
    room = F.when(F.col("end_a") <= F.col("end_b"), b <= F.col("cap_a")).otherwise(a <= F.col("cap_b"))
    apart = F.col("component_a") != F.col("component_b")
    enough = _at_least(a + b, both, percent) - F.greatest("rest_a", "rest_b")
    # A pair with few entries is told at its first common one only, with all it has in common; others are counted.
    common = F.array_intersect("tokens_a", "tokens_b")
    wide = F.col("tokens_a").isNull() | F.col("tokens_b").isNull()
    told = wide | ((F.get(common, F.lit(0)) == F.col("token")) & (F.size(common) >= enough))
    keys = ["node_a", "node_b", "n_a", "n_b", "rest_a", "rest_b"]

    def met(first: DataFrame, second: DataFrame) -> DataFrame:
        found = first.join(second, "token").filter(apart & ordered & _fits(a, b, percent) & room & told)
        return found.select(*keys, F.when(wide, F.lit(1)).otherwise(F.size(common)).alias("times"))

    pairs = met(left.filter("not main_a"), right).unionByName(met(left.filter("main_a"), right.filter("not main_b")))
    counted = pairs.groupBy(*keys).agg(F.sum("times").alias("times"))
    return counted.filter(F.col("times") >= enough).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _labelled(lists: DataFrame, links: DataFrame) -> DataFrame:
    labels = components(links)
    return lists.drop("component").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _prepared(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their classes, the classes with their nodes, and the lists of the classes' prefixes."""
    whole = docs.filter("doc_id is not null")
    rows = stored(_classes(docs, width), "classes")
    groups = rows.filter("n > 0 and doc_id is not null").groupBy("key", "digest").agg(F.min("doc_id").alias("node"))
    # A doc_id that stands for two different sets is one node, of which no bound is sure.
    twice = F.count(F.lit(1)).over(Window.partitionBy("node")) > 1
    groups = stored(groups.withColumn("twice", twice), "groups")
    counts = _corpus_counts(whole, width)
    postings = _postings(whole, width, percent, counts)
    lists = stored(_shared_lists(postings, groups.select("key", "node", "twice"), percent), "lists")
    return rows, groups, stored(_with_bounds(lists, percent).withColumn("component", F.col("node")), "bounded")


def _linked(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the similarity."""
    whole, pairs = docs.filter("doc_id is not null"), stored(pairs, "pairs")
    nodes = pairs.select(F.col("a").alias("node")).distinct().union(pairs.select("b").distinct()).distinct()
    return stored(_verified(pairs, stored(_sets(whole, width, nodes), "sets"), percent).distinct(), "found")


def ngram_links(
    docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) and (a, b): the class of every document, and all links between different sets.

    Documents with equal sets form a class and are linked with each other; its node is their smallest
    doc_id.  A link of two nodes stands for links of all documents of both.  The number of links grows
    with the square of a group of near copies; `ngram_components` needs far fewer of them.  Odd rows are
    treated as there; a document without n-grams or without doc_id has no node.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows, groups, lists = _prepared(docs, width, percent)
    links = _linked(docs, _cross_pairs(lists, percent), width, percent)
    named = rows.join(groups.select("key", "digest", "node"), ["key", "digest"], "left")
    return named.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")), links


def ngram_components(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id for every row of `docs`.

    component_id is the smallest doc_id reachable by links.  Defined results for odd rows: a null or
    empty text has no n-gram and is linked with nothing; a text with fewer words than `width` is one
    n-gram; equal rows get equal results; rows that share a doc_id but not their text are judged one by
    one; a row without doc_id is linked with nothing and has no component; further columns are left out.  Two different n-grams are taken for one if their
    64-bit hashes are equal.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows, groups, lists = _prepared(docs, width, percent)
    # Two leaders for each node: the hub of its lists, and one that a draw picks, for groups apart from the hub.
    stars = _star_pairs(lists, F.col("degree"), percent).unionByName(_star_pairs(lists, F.xxhash64("node"), percent))
    links = _linked(docs, stars.distinct(), width, percent)
    more = _linked(docs, _cross_pairs(stored(_labelled(lists, links), "lists"), percent), width, percent)

    labels = components(links.unionByName(more))
    named = groups.join(labels, "node", "left").select(
        "key", "digest", F.coalesce("component", "node").alias("component")
    )
    found = rows.join(named, ["key", "digest"], "left")
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )
