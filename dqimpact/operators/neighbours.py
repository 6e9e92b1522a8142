"""The nearest training rows of each test row, and their vote.

Equal vectors fall together first, with the number of rows of each class, so no pair of copies is ever
made.  The search is exact and has two steps:

- All vectors are placed along a few random directions; along each one the training vectors are cut
  into buckets of equally many, and a test vector meets those of its own bucket and of the two beside it.
  The nearest of these few tell how far the k nearest of all can be at most: the reach of the test vector.
- The training vectors are cut into cells by their own values, in passes over all cells at once.  A test
  vector is sent to every cell whose box is within its reach, and meets all vectors in it.  What is
  left out is farther than k rows that are known.

Bounds and distances are summed in the same order, and rounding keeps the order of numbers, so a bound
is never above the distance to a vector in its box, to the last bit.

The vectors of several tables may be searched at once: with a column `table` (a whole number) on both
sides, a test vector meets the training vectors of its own table only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from dqimpact.operators.running import running_totals
from dqimpact.session import durable

NEIGHBOURS = 5
DIRECTIONS = 8
BUCKET = 64

# Training vectors of a cell; cells get larger where there would be more than about CELLS of them.
CELL = 1_024
CELLS = 8_192
# A cell is cut, and its distance bounded, along the first so many columns.
# A bound by fewer columns is a smaller one, so nothing is lost.
AXES = 32
# A cell is cut at some of its eighths; they need not be exact, as they only tell how even the parts are.
EIGHTHS = tuple(i / 8 for i in range(1, 8))
ACCURACY = 200
# Test vectors that meet a cell in one task; where more do, several tasks hold the cell.
SLOT = 16_384
# Numbers of a matrix that a task works on.
BLOCK = 1 << 20


def _dot(vector: str, direction: np.ndarray) -> Column:
    weights = F.array(*[F.lit(float(w)) for w in direction])
    return F.aggregate(F.zip_with(vector, weights, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)


def _distance(a: str, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)


def _tables(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c == "table"]


def distinct_vectors(rows: DataFrame, vector: str = "vector", label: str = "y") -> DataFrame:
    """id, vector, pos, neg: each vector (of each table) once, with the rows of either class that hold it."""
    y = F.col(label)
    counted = rows.groupBy(*_tables(rows), F.col(vector).alias("vector")).agg(
        F.count(F.when(y == 1, 1)).alias("pos"), F.count(F.when(y == 0, 1)).alias("neg")
    )
    return counted.select(F.md5(F.array_join(F.transform("vector", lambda x: x.cast("string")), ",")).alias("id"), "*")


def _candidates(train: DataFrame, test: DataFrame, directions: Sequence[np.ndarray], k: int, bucket: int) -> DataFrame:
    """(test_id, near): for each bucket that a test vector meets, the k nearest (distance, id, pos, neg) in it.

    A bucket is one row with its training vectors, at most `bucket`, so no pair is ever a row of its own.
    """
    by = _tables(train)
    one = train.select(*by, "id", "vector", "pos", "neg", F.lit(1).cast("long").alias("counts"))
    other = test.select(*by, "id", "vector", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("long").alias("neg"), F.lit(0).cast("long").alias("counts"))
    places = F.array(*[_dot("vector", direction) for direction in directions])
    along = one.unionByName(other).select("*", F.posexplode(places).alias("direction", "at"))
    placed = running_totals(along, [*by, "direction"], ["at", "id", "counts"], {"place": F.col("counts")})
    placed = placed.withColumn("bucket", F.floor(F.col("place") / bucket))
    around = F.array(*[F.col("bucket") + d for d in (-1, 0, 1)])
    asked = placed.filter("counts = 0").select(
        *by, F.col("id").alias("test_id"), F.col("vector").alias("asked"), "direction", F.explode(around).alias("bucket")
    )
    held = placed.filter("counts = 1").groupBy(*by, "direction", "bucket").agg(
        F.collect_list(F.struct("id", "vector", "pos", "neg")).alias("held")
    )
    met = F.transform("held", lambda h: F.struct(_distance("asked", h["vector"]).alias("distance"), h["id"].alias("id"), h["pos"].alias("pos"), h["neg"].alias("neg")))
    return asked.join(held, [*by, "direction", "bucket"]).select(*by, "test_id", F.slice(F.array_sort(met), 1, k).alias("near"))


def _reaches(found: DataFrame, test: DataFrame, k: int) -> DataFrame:
    """The test vectors with their reach: the distance within which the candidates have k rows."""
    by = _tables(test)
    # A vector has a row at least, so k vectors are enough, of each bucket and of all.
    near = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k)
    none = F.struct(F.lit(0).cast("long").alias("rows"), F.lit(0.0).alias("reach"))

    def farther(so_far: Column, n: Column) -> Column:
        more = F.struct((so_far["rows"] + n["pos"] + n["neg"]).alias("rows"), n["distance"].alias("reach"))
        return F.when(so_far["rows"] < k, more).otherwise(so_far)

    reach = F.aggregate(near, none, farther, lambda end: F.when(end["rows"] >= k, end["reach"]))
    known = found.groupBy(*by, F.col("test_id").alias("id")).agg(reach.alias("reach"))
    # Too few candidates bound nothing.
    joined = test.join(known, [*by, "id"], "left")
    return joined.select(*test.columns, F.coalesce("reach", F.lit(math.inf)).alias("reach"))


def _table(rows: DataFrame) -> Column:
    return (F.col("table") if _tables(rows) else F.lit(0)).cast("long").alias("table")


def _cut(box: Row, most: int) -> tuple[int, list[float]] | None:
    """(axis, cuts): where to cut a box of too many vectors, None if they are alike on all axes."""
    step = 4 if box["rows"] <= 1.8 * most else 2 if box["rows"] <= 3.6 * most else 1
    best = None
    for axis, (low, high, eighths) in enumerate(zip(box["low"], box["high"], box["eighths"], strict=True)):
        # A cut leaves the least value below and the greatest above it, so every part holds some vector.
        cuts = sorted({c for c in eighths[step - 1 :: step] if low <= c < high}) or ([low] if low < high else [])
        if cuts:
            worth = ((eighths[-1] - eighths[0]) * math.log2(1 + len(cuts)), high - low)
            if best is None or worth > best[0]:
                best = worth, axis, cuts
    return best and best[1:]


def _cells(train: DataFrame, axes: int) -> tuple[DataFrame, dict[int, tuple[np.ndarray, ...]]]:
    """The training vectors with their `cell`, and for each table its cells, their lows and their highs.

    What is collected is a row for each cell, about CELLS in all.
    """
    at = [F.col("vector")[j] for j in range(axes)]
    measures = [
        F.count(F.lit(1)).alias("rows"),
        F.array(*[F.min(x) for x in at]).alias("low"),
        F.array(*[F.max(x) for x in at]).alias("high"),
        F.array(*[F.percentile_approx(x, EIGHTHS, ACCURACY) for x in at]).alias("eighths"),
    ]
    names = ["table", "id", "vector", "pos", "neg"]
    placed = train.select(_table(train), *names[1:3], *[F.col(c).cast("long").alias(c) for c in names[3:]])
    placed = placed.withColumn("cell", F.col("table"))
    boxes = placed.groupBy("table", "cell").agg(*measures).collect()
    most = max(CELL, sum(r["rows"] for r in boxes) // CELLS)
    fresh, done = 1 + max((r["cell"] for r in boxes), default=0), []
    while boxes:
        splits = []
        for box in boxes:
            cut = _cut(box, most) if box["rows"] > most else None
            if cut is None:
                done.append(box)
            else:
                splits.append((box["cell"], fresh, *cut))
                fresh += len(cut[1]) + 1
        if not splits:
            break
        told = train.sparkSession.createDataFrame(splits, "cell long, first long, axis int, cuts array<double>")
        below = F.size(F.filter("cuts", lambda c: c < F.col("vector")[F.col("axis")]))
        placed = placed.select(*names, "cell").join(F.broadcast(told), "cell", "left").select(
            *names, F.coalesce(F.col("first") + below, "cell").alias("cell"), F.col("first").isNotNull().alias("cut")
        )
        boxes = placed.filter("cut").groupBy("table", "cell").agg(*measures).collect()
    found: dict[int, list[Row]] = {}
    for box in done:
        found.setdefault(box["table"], []).append(box)
    return placed.select(*names, "cell"), {
        table: tuple(np.array([b[c] for b in some]) for c in ("cell", "low", "high")) for table, some in found.items()
    }


def _rows_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


_ROUTED = "table long, id string, vector array<double>, reach double, cell long"


def _router(boxes: Mapping[int, tuple[np.ndarray, ...]], axes: int) -> Callable:
    """Batches of (table, id, vector, reach), each row once for every cell that it reaches."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, reach = batch["table"].to_numpy(), batch["reach"].to_numpy()
            for known in set(table.tolist()) & set(boxes):
                (cells, low, high), mine = boxes[known], np.flatnonzero(table == known)
                x = _rows_of(batch["vector"])
                step = max(1, BLOCK // len(cells))
                for some in (mine[at : at + step] for at in range(0, len(mine), step)):
                    bound = np.zeros((len(some), len(cells)))
                    with np.errstate(invalid="ignore", over="ignore"):
                        for j in range(axes):
                            mid = x[some, j, None]
                            gap = np.maximum(np.maximum(low[:, j] - mid, mid - high[:, j]), 0.0)
                            bound += gap * gap
                    # What has no number as its bound is not left out.
                    row, cell = np.nonzero(~(bound > reach[some, None]))
                    sent = batch.take(pa.array(some[row]))
                    yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(cells[cell])], [*sent.schema.names, "cell"])

    return route


_FOUND = "table long, test_id string, distance double, id string, pos long, neg long"


def _met(asked: pa.RecordBatch, held: pa.Table, v: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """For each row of `asked`, the k nearest of `held` within its reach; `held` is in the order of ids."""
    x, reach = _rows_of(asked["vector"]), asked["reach"].to_numpy(zero_copy_only=False)
    step = max(1, BLOCK // len(v))
    for at in range(0, len(x), step):
        distance, limit = np.zeros((len(x[at : at + step]), len(v))), reach[at : at + step]
        with np.errstate(invalid="ignore", over="ignore"):
            for j in range(x.shape[1]):
                apart = x[at : at + step, j, None] - v[:, j]
                distance += apart * apart
        if k < len(v):
            limit = np.fmin(limit, np.partition(distance, k - 1, axis=1)[:, k - 1])
        row, col = np.nonzero(~(distance > limit[:, None]))
        order = np.lexsort((col, distance[row, col], row))
        row, col = row[order], col[order]
        nearest_ones = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, col = row[nearest_ones], col[nearest_ones]
        mine, theirs = asked.slice(at, step).select(["table", "id"]).take(pa.array(row)), held.take(pa.array(col))
        columns = [*mine.columns, pa.array(distance[row, col]), *[theirs[c].combine_chunks() for c in ("id", "pos", "neg")]]
        yield pa.RecordBatch.from_arrays(columns, ["table", "test_id", "distance", "id", "pos", "neg"])


def _searcher(k: int) -> Callable:
    """Batches sorted by (slot, asks, id): of each slot first the training vectors, then the test vectors."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, held, index = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            slots, asks = batch["slot"].to_numpy(), batch["asks"].to_numpy()
            edges = np.flatnonzero((np.diff(slots) != 0) | (np.diff(asks) != 0)) + 1
            for start, end in pairwise([0, *edges.tolist(), len(slots)]):
                piece = batch.slice(start, end - start)
                if slots[start] != slot:
                    slot, held, index = slots[start], [], None
                if not asks[start]:
                    held.append(piece)
                elif held:
                    if index is None:
                        index = np.concatenate([_rows_of(h["vector"]) for h in held])
                        whole = pa.Table.from_batches([h.select(["id", "pos", "neg"]) for h in held]).combine_chunks()
                    yield from _met(piece, whole, index, k)

    return search


def _within_reach(train: DataFrame, reached: DataFrame, width: int, k: int) -> DataFrame:
    """table, test_id, distance, id, pos, neg: of every cell within reach of a test vector, its k nearest in there."""
    axes = min(width, AXES)
    placed, boxes = _cells(train, axes)
    asked = reached.select(_table(reached), "id", "vector", "reach")
    routed = durable(asked.mapInArrow(_router(boxes, axes), _ROUTED))
    slots, first = [], 0
    for r in routed.groupBy("cell").count().collect():
        parts = -(-r["count"] // SLOT)
        slots.append((r["cell"], first, parts))
        first += parts
    dealt = F.broadcast(train.sparkSession.createDataFrame(slots, "cell long, first long, parts long"))
    held = placed.join(dealt, "cell").select(
        F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)).alias("slot"), F.lit(0).alias("asks"),
        "table", "id", "vector", "pos", "neg", F.lit(None).cast("double").alias("reach"),
    )
    none = F.lit(None).cast("long")
    asked = routed.join(dealt, "cell").select(
        (F.col("first") + F.pmod(F.xxhash64("id"), "parts")).alias("slot"), F.lit(1).alias("asks"),
        "table", "id", "vector", none.alias("pos"), none.alias("neg"), "reach",
    )
    sorted_rows = held.unionByName(asked).repartition("slot").sortWithinPartitions("slot", "asks", "id")
    return sorted_rows.mapInArrow(_searcher(k), _FOUND)


def with_reach(
    train: DataFrame, test: DataFrame, width: int, k: int = NEIGHBOURS, directions: int = DIRECTIONS,
    bucket: int = BUCKET, seed: int = 42,
) -> DataFrame:
    """The test vectors and `reach`, a distance within which there are k training rows, if there are as many."""
    rng = np.random.default_rng(seed)
    found = _candidates(train, test, [rng.normal(size=width) for _ in range(directions)], k, bucket)
    return _reaches(found, test, k)


def nearest_within(train: DataFrame, reached: DataFrame, width: int, k: int = NEIGHBOURS) -> DataFrame:
    """What `nearest` returns, for test vectors whose reach is known."""
    by = _tables(train)
    whole = _within_reach(train, reached, width, k)
    near = F.slice(F.array_sort(F.collect_list(F.struct("distance", "id", "pos", "neg"))), 1, k)
    best = whole.groupBy(*by, "test_id").agg(near.alias("near")).select(*by, "test_id", F.inline("near"))
    before = Window.partitionBy(*by, "test_id").orderBy("distance", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = F.col("pos") + F.col("neg")
    taken = F.least(rows, k - F.coalesce(F.sum(rows).over(before), F.lit(0)))
    return best.select(*by, "test_id", "id", "distance", "pos", "neg", taken.alias("taken")).filter("taken > 0")


def nearest(train: DataFrame, test: DataFrame, width: int, k: int = NEIGHBOURS, **options) -> DataFrame:
    """test_id, id, distance, pos, neg, taken: for each distinct test vector the vectors of its k nearest rows.

    Both sides are results of `distinct_vectors`.  `taken` is the number of rows that a vector gives to
    the k; of the last one it may be a part.  Vectors at equal distance are taken in the order of their ids.
    Nothing is left out: the options of `with_reach` tell only how soon the search is narrow.
    """
    return nearest_within(train, with_reach(train, test, width, k, **options), width, k)


def voted(asked: DataFrame, found: DataFrame) -> DataFrame:
    """(decision, pos, neg) over distinct test vectors: the share of class 1 among the k nearest rows less a half."""
    by = _tables(asked)
    votes = found.groupBy(*by, F.col("test_id").alias("id")).agg(
        F.sum(F.col("taken") * F.col("pos") / (F.col("pos") + F.col("neg"))).alias("for"), F.sum("taken").alias("all")
    )
    joined = asked.join(votes, [*by, "id"], "left")
    # Without any training row there is no vote, and class 0 is told.
    return joined.select(*by, F.coalesce(F.col("for") / F.col("all") - 0.5, F.lit(0.0)).alias("decision"), "pos", "neg")


def neighbour_counts(train: DataFrame, test: DataFrame, width: int, k: int = NEIGHBOURS, **options) -> DataFrame:
    """What `voted` tells of test rows.  Both sides hold (vector, y), and `table` where there are several.

    The rows of one vector vote together, in proportion to their classes.
    """
    known, asked = durable(distinct_vectors(train)), durable(distinct_vectors(test))
    return voted(asked, nearest(known, asked.select(*_tables(asked), "id", "vector"), width, k, **options))


_KNOWN = "id string, vector array<double>, pos long, neg long"


def store_for_later(train: DataFrame, test: DataFrame, width: int, table: int, folder: str) -> None:
    """Leave the vectors of one table in `folder`, those of test rows (vector, y) with their reach."""
    spark, path = train.sparkSession, f"table={table}"
    distinct_vectors(train).write.parquet(f"{folder}/known/{path}")
    known, asked = spark.read.schema(_KNOWN).parquet(f"{folder}/known/{path}"), durable(distinct_vectors(test))
    with_reach(known, asked, width).write.parquet(f"{folder}/asked/{path}")


def counts_of_stored(spark: SparkSession, folder: str) -> DataFrame:
    """(table, decision, pos, neg): what `neighbour_counts` tells of each table in `folder`, all searched at once."""
    known = spark.read.schema(f"{_KNOWN}, table int").parquet(f"{folder}/known")
    asked = spark.read.schema(f"{_KNOWN}, reach double, table int").parquet(f"{folder}/asked")
    width = known.unionByName(asked.drop("reach")).agg(F.max(F.size("vector"))).first()[0] or 1
    # A column more that is 0 on both sides changes no distance.
    filled = F.concat("vector", F.array_repeat(F.lit(0.0), width - F.size("vector")))
    known, asked = known.withColumn("vector", filled), asked.withColumn("vector", filled)
    return voted(asked, nearest_within(known, asked, width))
