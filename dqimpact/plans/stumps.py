"""AdaBoost over stumps for many tables at once: a round is one pass over all of them.

The trees are those that `fit_adaboost` gets from Spark ML at depth 1: the same thresholds, gains and
votes.  Rows with equal designs and labels weigh alike in every round, so they are held once, with their
number.  A weight follows from the stumps before it and is stored nowhere; a round adds up the weights of
each class by feature and bin, which is all that the driver gets.  As in Spark ML's trees, thresholds are
quantiles of the weights, from all rows of a table or, beyond `SAMPLED` rows, from about so many of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqimpact.plans.boosting import ROUNDS
from dqimpact.session import durable

# As in Spark ML's trees: bins of a feature, and rows from which their bounds are found.
BINS = 32
SAMPLED = 10_000
SEED = 42

_BLOCKS = "table int, size int, x binary, rest binary"


@dataclass(frozen=True)
class Stump:
    """What rows up to the threshold of a feature are told, and the others; `raised` is by what a wrong row's weight grows."""

    feature: int
    threshold: float
    left: float
    right: float
    raised: float = 1.0
    scale: float = 1.0

    def tell(self, x: np.ndarray) -> np.ndarray:
        return np.where(x[self.feature] <= self.threshold, self.left, self.right)


def weights(stumps: Sequence[Stump], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The weight of a single row, after these stumps; `x` has a row for each feature."""
    weight = np.ones(len(y))
    for stump in stumps:
        weight = weight * np.where(stump.tell(x) != y, stump.raised, 1.0) * stump.scale
    return weight


def training_rows(design: DataFrame, total: int) -> DataFrame:
    """x, y, n, s: each row of (design, y) once, its number, and how many of those are among the sampled ones."""
    share = SAMPLED / max(total, SAMPLED)
    taken = F.lit(1.0) if share == 1 else F.when(F.rand(SEED) < share, 1.0).otherwise(0.0)
    rows = design.select(vector_to_array("design").alias("x"), "y", taken.alias("s"))
    return rows.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("s").alias("s"))


def test_rows(design: DataFrame) -> DataFrame:
    """x, pos, neg: each design once, with the rows of either class."""
    y = F.col("y")
    return design.groupBy(vector_to_array("design").alias("x")).agg(
        *[F.count(F.when(y == c, 1)).cast("double").alias(name) for c, name in ((1, "pos"), (0, "neg"))]
    )


def _packed(rows: DataFrame, *names: str) -> DataFrame:
    """Rows of a table in blocks: the designs by feature, then the columns of these names."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table in pc.unique(batch.column(0)).to_pylist():
                own = batch.filter(pc.equal(batch.column(0), table))
                x = own.column(1).flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1)
                rest = np.stack([own.column(2 + i).to_numpy(zero_copy_only=False) for i, _ in enumerate(names)])
                parts = ([table], [own.num_rows], [np.ascontiguousarray(x.T).tobytes()], [rest.tobytes()])
                types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(*p) for p in zip(parts, types, strict=True)], names=["table", "size", "x", "rest"])

    return rows.select(F.col("table").cast("int").alias("table"), "x", *names).mapInArrow(pack, _BLOCKS)


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for table, size, x, rest in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
        yield table, np.frombuffer(x).reshape(-1, size), np.frombuffer(rest).reshape(-1, size)


def _thresholds(values: np.ndarray, mass: np.ndarray, seen: float, whole: float, bins: int) -> np.ndarray:
    """Bounds between bins of like weight; `seen` of all rows have a value other than 0, which has what is left of `whole`."""
    other = values != 0
    values, mass = values[other], mass[other]
    rest = whole - mass.sum()
    if len(values) and rest > np.finfo(float).eps * seen * seen:
        at = np.searchsorted(values, 0.0)
        values, mass = np.insert(values, at, 0.0), np.insert(mass, at, rest)
    if len(values) < 2:
        return np.empty(0)
    middles = (values[1:] + values[:-1]) / 2
    if len(middles) < bins:
        return middles
    sums = np.cumsum(mass)
    turns, stride = (sums[1:] + sums[:-1]) / 2, whole / bins
    found, at = [], 0
    while at < len(turns):
        # The first place whose total is further from the wanted one than the total before it.
        at = max(at, int(np.searchsorted(turns, stride * (len(found) + 1), "right")))
        if at < len(turns):
            found.append(at)
        at += 1
    return middles[found]


def _gini(of: np.ndarray) -> np.ndarray:
    total = of.sum(axis=0)
    return 1.0 - ((of / np.where(total > 0, total, 1.0)) ** 2).sum(axis=0)


@dataclass
class _Booster:
    """One table on the way: its sampled rows and the stumps found so far."""

    total: int
    x: np.ndarray
    y: np.ndarray
    s: np.ndarray
    stumps: list[Stump] = field(default_factory=list)
    says: list[float] = field(default_factory=list)
    done: bool = False

    def __post_init__(self) -> None:
        self.values = [np.unique(column, return_inverse=True) for column in self.x]

    def bounds(self) -> list[np.ndarray]:
        weight = weights(self.stumps, self.x, self.y) * self.s
        whole = self.total * min(1.0, SAMPLED / self.total)
        bins = min(BINS, self.total)
        return [
            _thresholds(values, np.bincount(places, weight, len(values)), self.s[column != 0].sum(), whole, bins)
            for column, (values, places) in zip(self.x, self.values, strict=True)
        ]

    def grow(self, bounds: list[np.ndarray], sums: list[np.ndarray], rounds: int) -> None:
        """Take the best stump; `sums` are rows and the weights of both classes, by feature and bin."""
        best, chosen = 0.0, None
        for feature, (cuts, held) in enumerate(zip(bounds, sums, strict=True)):
            if not len(cuts):
                continue
            left = np.cumsum(held, axis=1)[:, :-1]
            whole = held.sum(axis=1, keepdims=True)
            right = whole - left
            all_, of_left = whole[1:].sum(), left[1:].sum(axis=0)
            gain = _gini(whole[1:]) - of_left / all_ * _gini(left[1:]) - (all_ - of_left) / all_ * _gini(right[1:])
            gain[(left[0] < 1) | (right[0] < 1)] = -1.0
            at = int(np.argmax(gain))
            if gain[at] > best:
                best, chosen = gain[at], (feature, at)
        if chosen is None:
            sides = [sums[0][1:].sum(axis=1)] * 2
            feature, threshold, missed = 0, math.inf, sides[0].min()
        else:
            feature, at = chosen
            # Summed apart, so that what no row has is zero.
            sides = [part.sum(axis=1) for part in (sums[feature][1:, : at + 1], sums[feature][1:, at + 1 :])]
            threshold, missed = bounds[feature][at], sides[0].min() + sides[1].min()
        told = [float(side[1] > side[0]) for side in sides]
        error = missed / self.total
        if error >= 0.5 or error <= 0:
            self.done = True
            if error <= 0 or not self.stumps:
                self.stumps.append(Stump(feature, threshold, *told))
                self.says.append(1.0)
            return
        raised = (1 - error) / error
        grown = (self.total - missed) + missed * raised
        self.stumps.append(Stump(feature, threshold, *told, raised, self.total / grown))
        self.says.append(math.log(raised))
        self.done = len(self.stumps) == rounds


def _round(blocks: DataFrame, growing: dict[int, _Booster]) -> Iterator[tuple[int, list[np.ndarray], list[np.ndarray]]]:
    """Of each table: the bounds of this round, and rows and weights of both classes by feature and bin."""
    known = {table: (booster.bounds(), booster.stumps) for table, booster in growing.items()}
    # A sample may weigh more than expected, and then has bounds beyond `BINS`.
    most = 1 + max(len(cuts) for bounds, _ in known.values() for cuts in bounds)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for table, x, (y, n, _) in _unpacked(batch):
                if table not in known:
                    continue
                bounds, stumps = known[table]
                sums = held.setdefault(table, np.zeros((len(bounds), 3, most)))
                weight = weights(stumps, x, y) * n
                for feature, cuts in enumerate(bounds):
                    places = np.searchsorted(cuts, x[feature])
                    for row, mass in enumerate((n, weight * (y == 0), weight * (y == 1))):
                        sums[feature, row] += np.bincount(places, mass, most)
        if held:
            packed = [sums.tobytes() for sums in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(packed, pa.binary())], names=["table", "sums"])

    found: dict[int, np.ndarray] = {}
    for row in blocks.mapInArrow(add_up, "table int, sums binary").collect():
        bounds = known[row["table"]][0]
        sums = np.frombuffer(row["sums"]).reshape(len(bounds), 3, most)
        found[row["table"]] = found[row["table"]] + sums if row["table"] in found else sums
    for table, sums in found.items():
        bounds = known[table][0]
        yield table, bounds, [part[:, : len(cuts) + 1] for part, cuts in zip(sums, bounds, strict=True)]


def fit_stumps(rows: DataFrame, rounds: int = ROUNDS) -> dict[int, tuple[list[Stump], list[float]]]:
    """The stumps of each table with their say, from (table, x, y, n, s); see `training_rows`."""
    blocks = durable(_packed(rows, "y", "n", "s"))
    totals = {r["table"]: int(r["n"]) for r in rows.groupBy("table").agg(F.sum("n").alias("n")).collect()}
    sampled: dict[int, list] = {}
    for row in _packed(rows.filter("s > 0"), "y", "s").collect():
        sampled.setdefault(row["table"], []).append((np.frombuffer(row["x"]).reshape(-1, row["size"]), np.frombuffer(row["rest"]).reshape(2, -1)))
    boosters = {
        table: _Booster(totals[table], np.hstack([x for x, _ in parts]), *np.hstack([rest for _, rest in parts]))
        for table, parts in sampled.items()
    }
    while growing := {table: booster for table, booster in boosters.items() if not booster.done}:
        for table, bounds, sums in _round(blocks, growing):
            boosters[table].grow(bounds, sums, rounds)
    return {table: (booster.stumps, booster.says) for table, booster in boosters.items()}


def stump_counts(fitted: dict[int, tuple[list[Stump], list[float]]], rows: DataFrame) -> DataFrame:
    """(table, decision, pos, neg) from (table, x, pos, neg): what the stumps say for class 1 less what they say for class 0."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table, x, counts in _unpacked(batch):
                stumps, says = fitted[table]
                said = sum(say * (2 * stump.tell(x) - 1) for stump, say in zip(stumps, says, strict=True)) / sum(says)
                values, places = np.unique(said, return_inverse=True)
                pos, neg = (np.bincount(places, c, len(values)).astype(np.int64) for c in counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(values), table, np.int32)), pa.array(values), pa.array(pos), pa.array(neg)],
                    names=["table", "decision", "pos", "neg"],
                )

    found = _packed(rows, "pos", "neg").mapInArrow(decide, "table int, decision double, pos long, neg long")
    return found.groupBy("table", "decision").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
