"""AdaBoost, nearest neighbours and permutation importance against plain versions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from dqimpact.operators import neighbours
from dqimpact.plans import importance, learners, stumps
from dqimpact.plans.boosting import fit_adaboost
from dqimpact.queries import sweeps
from dqimpact.queries.correlation import labelled_documents
from dqimpact.sources.config import FeatureSpec


def _design(df, *names):
    return VectorAssembler(inputCols=list(names), outputCol="design").transform(df)


def plain_adaboost(x: np.ndarray, y: np.ndarray, rounds: int) -> np.ndarray:
    """Decisions of discrete AdaBoost over stumps, best split by weighted Gini impurity."""
    weight, says, told = np.ones(len(y)), [], []

    def impurity(rows):
        total, ones = weight[rows].sum(), weight[rows & (y == 1)].sum()
        return 2 * ones * (total - ones) / total if total else 0.0

    for _ in range(rounds):
        best = None
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            for cut in (values[1:] + values[:-1]) / 2:
                left = x[:, j] <= cut
                cost = impurity(left) + impurity(~left)
                if best is None or cost < best[0] - 1e-12:
                    best = cost, left
        left = best[1]
        sides = [weight[s & (y == 1)].sum() > weight[s & (y == 0)].sum() for s in (left, ~left)]
        vote = np.where(left, *[float(s) for s in sides])
        error = weight[vote != y].sum() / weight.sum()
        if error >= 0.5:
            break
        told.append(vote)
        if error == 0:
            says.append(1.0)
            break
        says.append(math.log((1 - error) / error))
        weight = weight * np.where(vote != y, (1 - error) / error, 1)
        weight *= len(y) / weight.sum()
    return sum(s * (2 * v - 1) for s, v in zip(says, told, strict=True)) / sum(says)


def test_adaboost_against_a_plain_version(spark, folder):
    docs = labelled_documents(spark, folder).withColumns(
        {"size": F.least(F.floor(F.col("n_chars") / 150), F.lit(20)).cast("double"), "bad": F.col("toxic").cast("double"),
         "y": F.col("quality").cast("double"), "tail": F.crc32(F.col("doc_id").cast("string")) % 9}
    ).filter("y is not null and bad is not null")
    rows = _design(docs.select("doc_id", "size", "bad", F.col("tail").cast("double").alias("tail"), "y"), "size", "bad", "tail")
    made = fit_adaboost(rows, rounds=12)
    got = {r["doc_id"]: r["decision"] for r in made.decide(rows).select("doc_id", "decision").collect()}
    data = rows.select("doc_id", "size", "bad", "tail", "y").toPandas().sort_values("doc_id")
    wanted = plain_adaboost(data[["size", "bad", "tail"]].to_numpy(), data["y"].to_numpy(), 12)
    assert len(made.trees) == 12
    assert np.allclose([got[i] for i in data["doc_id"]], wanted, atol=1e-9)


def test_adaboost_ends_early(spark):
    easy = _design(spark.createDataFrame([(float(i), float(i > 5)) for i in range(12)], "a double, y double"), "a")
    assert len(fit_adaboost(easy).trees) == 1
    hopeless = _design(spark.createDataFrame([(1.0, float(i % 2)) for i in range(12)], "a double, y double"), "a")
    made = fit_adaboost(hopeless)
    assert len(made.trees) == 1 and made.decide(hopeless).filter("decision is null").count() == 0


def test_stumps_of_many_tables_are_those_of_adaboost(spark):
    rng = np.random.default_rng(6)
    made, asked, wanted = [], [], {}
    for table, rows in enumerate((900, 40, 25)):
        # Many values, few, zeros among others, and copies.
        x = np.column_stack([rng.lognormal(size=rows).round(2), rng.integers(-2, 3, rows), rng.random(rows) < 0.2]).astype(float)
        x[: rows // 3] = x[0]
        y = (x[:, 0] + x[:, 1] + rng.normal(size=rows) > 1).astype(float)
        frame = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
        design = _design(frame, "a", "b", "c").select("design", "y")
        made.append(stumps.training_rows(design, rows).withColumn("table", F.lit(table)))
        asked.append(stumps.test_rows(design).withColumn("table", F.lit(table)))
        told = fit_adaboost(design, rounds=9).decide(design)
        wanted[table] = {(round(r["decision"], 9), r["pos"], r["neg"]) for r in learners.decision_counts(told.withColumn("model", F.lit(table))).collect()}
    fitted = stumps.fit_stumps(made[0].unionByName(made[1]).unionByName(made[2]), rounds=9)
    got = {table: set() for table in wanted}
    for r in stumps.stump_counts(fitted, asked[0].unionByName(asked[1]).unionByName(asked[2])).collect():
        got[r["table"]].add((round(r["decision"], 9), r["pos"], r["neg"]))
    assert got == wanted


def test_stumps_of_sampled_rows_may_have_more_bounds(spark, monkeypatch):
    frame = spark.createDataFrame([(float(i), float(i % 7 > 2 or i > 60)) for i in range(100)], "a double, y double")
    rows = stumps.training_rows(_design(frame, "a"), 100).withColumn("table", F.lit(3))
    monkeypatch.setattr(stumps._Booster, "bounds", lambda self: [np.arange(50) + 0.5])
    assert len(stumps.fit_stumps(rows, rounds=2)[3][0]) == 2


def test_a_sweep_of_stumps_has_a_pass_for_each_round(spark, folder, monkeypatch):
    """Not one for each round of each table."""
    passes = []
    grown = stumps._round
    monkeypatch.setattr(stumps, "_round", lambda *a: passes.append(1) or grown(*a))
    train, test = sweeps._halves(spark, folder)
    tasks = [learners.Task(t.error, t.feature, t.role, t.levels[::3], t.models) for t in sweeps._learner_tasks(("ada",))[1:4:2]]
    assert len(learners.ml_sweep(train, test, sweeps.TEXT_SPEC, tasks, "doc_id", "documents", ("ada",)).collect()) == 5
    assert 0 < len(passes) <= 50


def _vectors(spark, x, y):
    rows = [(i, [float(v) for v in row], int(label)) for i, (row, label) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "n int, vector array<double>, y int")


def test_neighbours_are_exact_where_buckets_hold_everything(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 3)), 1)
    x[:100] = x[0]
    y = (x[:, 0] + rng.normal(size=300) > 0).astype(int)
    whole = _vectors(spark, x, y)
    train, test = whole.filter("n % 5 > 0"), whole.filter("n % 5 = 0")
    got = neighbours.neighbour_counts(train, test, 3, k=5, directions=1, bucket=1_000).collect()
    assert sum(r["pos"] + r["neg"] for r in got) == test.count()

    known, vectors = np.arange(300) % 5 > 0, {}
    for row, label in zip(x[known], y[known], strict=True):
        counts = vectors.setdefault(tuple(row), [0, 0])
        counts[label] += 1
    names = neighbours.distinct_vectors(train).select("id", "vector").collect()
    name = {tuple(r["vector"]): r["id"] for r in names}
    wanted = []
    for point in {tuple(row) for row in x[~known]}:
        order = sorted(vectors, key=lambda v: (sum((a - b) * (a - b) for a, b in zip(point, v)), name[v]))
        left, votes = 5, 0.0
        for v in order:
            take = min(left, sum(vectors[v]))
            votes += take * vectors[v][1] / sum(vectors[v])
            left -= take
        wanted.append(round(votes / 5 - 0.5, 9))
    assert sorted(round(r["decision"], 9) for r in got) == sorted(wanted)


def test_recall_of_neighbours(spark):
    """Rows divisible by 100 against all others, on a skewed table of mixed columns."""
    rng = np.random.default_rng(4)
    n = 6_000
    x = np.column_stack([rng.lognormal(size=n), rng.integers(0, 2, n), rng.normal(size=n), rng.integers(0, 4, n)])
    asked = np.arange(n) % 100 == 0
    whole = _vectors(spark, x, np.zeros(n)).withColumn("id", F.col("n").cast("string"))
    known = whole.filter("n % 100 > 0").select("id", "vector", F.lit(1).alias("pos"), F.lit(0).alias("neg"))
    found = neighbours.nearest(known, whole.filter("n % 100 = 0").select("id", "vector"), 4).collect()
    got: dict[int, set] = {}
    for r in found:
        got.setdefault(int(r["test_id"]), set()).add(int(r["id"]))
    hits, others = 0, np.flatnonzero(~asked)
    for i in np.flatnonzero(asked):
        nearest = others[np.argsort(((x[others] - x[i]) ** 2).sum(axis=1), kind="stable")[:5]]
        hits += len(got[i] & set(nearest.tolist()))
    assert hits / (5 * asked.sum()) >= 0.9


def test_candidates_are_cut_before_they_are_dealt(spark):
    """A row for each bucket that a test vector meets, not one for each pair in it."""
    whole = _vectors(spark, np.arange(1_000.0)[:, None], np.zeros(1_000)).withColumn("id", F.col("n").cast("string"))
    known = whole.filter("n % 10 > 0").select("id", "vector", F.lit(1).alias("pos"), F.lit(0).alias("neg"))
    asked = whole.filter("n % 10 = 0").select("id", "vector")
    found = neighbours._candidates(known, asked, [np.ones(1), -np.ones(1)], 5, 64).collect()
    assert len(found) <= 100 * 2 * 3 and all(len(r["near"]) <= 5 for r in found)


def _nearest_rows(known, vectors, point, k):
    """(id, distance, taken) by comparing a point with every vector, sums in the order of columns."""
    apart = np.zeros(len(vectors))
    for j in range(vectors.shape[1]):
        apart += (point[j] - vectors[:, j]) * (point[j] - vectors[:, j])
    found, left = [], k
    for i in sorted(range(len(known)), key=lambda i: (apart[i], known[i]["id"])):
        take = min(left, known[i]["pos"] + known[i]["neg"])
        found += [(known[i]["id"], apart[i], take)] if take else []
        left -= take
    return found


def _spread_rows(kind: str) -> np.ndarray:
    rng = np.random.default_rng(11)
    if kind == "mixed":
        return np.column_stack([rng.lognormal(size=2_500) * 3, rng.integers(0, 3, (2_500, 2)), rng.normal(size=(2_500, 4))])
    if kind == "ties":  # few values, so that many vectors are equally far and many rows are copies
        return rng.integers(0, 5, (2_500, 5)).astype(float)
    # Near ones whose other columns differ in sign are far apart along most directions.
    return np.where(rng.random((2_500, 40)) < 0.05, 1.0, 0.0) + np.round(rng.normal(size=(2_500, 40)), 2)


@pytest.mark.parametrize(
    ("kind", "options"), [("mixed", {}), ("wide", {}), ("mixed", {"directions": 1, "bucket": 2}), ("ties", {"directions": 1, "bucket": 2})]
)
def test_neighbours_are_exact(spark, monkeypatch, kind, options):
    """Ids, distances and rows are those of all pairs, whatever the buckets miss; cells and slots are small."""
    monkeypatch.setattr(neighbours, "CELL", 40, raising=False)
    monkeypatch.setattr(neighbours, "SLOT", 30, raising=False)
    x = _spread_rows(kind)
    whole = _vectors(spark, x, np.arange(len(x)) % 3 == 0)
    train = neighbours.distinct_vectors(whole.filter("n % 10 > 0")).persist()
    test = neighbours.distinct_vectors(whole.filter("n % 10 = 0")).persist()
    got: dict[str, list] = {}
    for r in neighbours.nearest(train, test.select("id", "vector"), x.shape[1], **options).collect():
        got.setdefault(r["test_id"], []).append((r["id"], r["distance"], r["taken"]))
    known, asked = train.collect(), test.collect()
    train.unpersist()
    test.unpersist()
    vectors = np.array([r["vector"] for r in known])
    assert len(got) == len(asked)
    for r in asked:
        assert sorted(got[r["id"]], key=lambda n: (n[1], n[0])) == _nearest_rows(known, vectors, r["vector"], 5)


def test_neighbours_of_few_rows_and_of_several_tables(spark):
    """A table with fewer rows than are asked gives all of them, and none to another table."""
    rows = [(0, float(i), 0) for i in range(3)] + [(1, float(i), 1) for i in range(200)]
    train = spark.createDataFrame(rows, "table int, v double, y int").select("table", F.array("v").alias("vector"), "y")
    test = spark.createDataFrame([(0, 1.2), (1, 1.2), (2, 1.2)], "table int, v double").select("table", F.array("v").alias("vector"), F.lit(1).alias("y"))
    known, asked = neighbours.distinct_vectors(train), neighbours.distinct_vectors(test)
    got: dict[int, set] = {}
    for r in neighbours.nearest(known, asked, 1).collect():
        got.setdefault(r["table"], set()).add(round(r["distance"], 6))
    assert got == {0: {0.04, 0.64, 1.44}, 1: {0.04, 0.64, 1.44, 3.24, 7.84}}
    decisions = {r["table"]: r["decision"] for r in neighbours.neighbour_counts(train, test, 1).collect()}
    assert decisions == {0: -0.5, 1: 0.5, 2: 0.0}


def test_neighbours_without_a_number(spark):
    """A distance that is no number is farther than all others, and leaves none of them out."""
    nan, inf = math.nan, math.inf
    known = [(f"k{i:03}", [float(i), float(i % 7)], 1, 0) for i in range(100)] + [("k900", [nan, 1.0], 1, 0), ("k901", [inf, 1.0], 1, 0)]
    train = spark.createDataFrame(known, "id string, vector array<double>, pos long, neg long")
    test = spark.createDataFrame([("a", [50.0, 1.0]), ("b", [nan, 1.0]), ("c", [-inf, 1.0])], "id string, vector array<double>")
    got: dict[str, list] = {}
    for r in sorted(neighbours.nearest(train, test, 2, directions=1, bucket=2).collect(), key=lambda r: (r["distance"], r["id"])):
        got.setdefault(r["test_id"], []).append(r["id"])
    assert got["a"] == ["k050", "k049", "k051", "k052", "k053"]
    first = [k[0] for k in known[:5]]
    assert got["b"] == first and sorted(got["c"]) == first


def test_few_rows_are_fitted_in_few_tasks(spark, folder, monkeypatch):
    """Every iteration of a learner is a job of as many tasks as its table has partitions."""
    tasks = []

    class Counted:
        def fit(self, design):
            tasks.append(design.rdd.getNumPartitions())
            return learners.LogisticRegression(featuresCol="design", labelCol="y", maxIter=1).fit(design)

    monkeypatch.setattr(learners, "learner", lambda *_: Counted())
    train, test = sweeps._halves(spark, folder)
    rows = train.repartition(7)
    assert learners._counts_of_models(rows, learners.prepared(test, sweeps.TEXT_SPEC), sweeps.TEXT_SPEC, [(0, "svm")], "").count()
    assert tasks == [1]


def test_neighbours_of_nothing(spark):
    some = _vectors(spark, [[1.0], [2.0]], [1, 0])
    none = some.filter("false")
    assert neighbours.neighbour_counts(some, none, 1).count() == 0
    assert {r["decision"] for r in neighbours.neighbour_counts(none, some, 1).collect()} == {0.0}


@pytest.mark.parametrize("code", ["ada", "knn"])
def test_learners_run_in_sweeps(spark, folder, code):
    train, test = sweeps._halves(spark, folder)
    (task,) = [t for t in sweeps._learner_tasks((code,)) if t.error == "labels"]
    short = learners.Task(task.error, task.feature, task.role, task.levels[::2], task.models)
    rows = learners.ml_sweep(train, test, sweeps.TEXT_SPEC, [short], "doc_id", "documents", (code,)).collect()
    assert [r["percentage"] for r in sorted(rows, key=lambda r: r["percentage"])] == [0.0, 0.2, 0.6]
    assert all(0 <= r["Auc"] <= 1 and r["modelName"] == learners.NAMES[code] for r in rows)


def test_dealt_anew_is_a_permutation_that_all_features_share(spark):
    rows = spark.createDataFrame([(i % 2, i, i * 10) for i in range(50)], "g int, k int, v int")
    pairs = importance.dealt_anew(rows, "k", ["g"], repeats=3).collect()
    assert len(pairs) == 150
    for g in (0, 1):
        for repeat in range(3):
            mine = [r for r in pairs if r["g"] == g and r["repeat"] == repeat]
            donors = [r["donor"]["k"] for r in mine]
            assert sorted(donors) == sorted(r["own"]["k"] for r in mine) and donors != [r["own"]["k"] for r in mine]


def test_label_importance_against_scoring_one_by_one(spark):
    rng = np.random.default_rng(8)
    table = [(i, int(a), int(b), float(a > 4)) for i, (a, b) in enumerate(rng.integers(0, 10, (120, 2)))]
    df = spark.createDataFrame(table, "id long, a int, b int, y double")
    spec = FeatureSpec("y", {"discrete": ("a", "b")})
    rows = learners.prepared(df, spec, "id")
    shaped = learners.Pipeline(stages=learners.design_stages(spec)).fit(rows)
    model = learners.learner("dt", 2).fit(shaped.transform(rows))
    got = {(r["feature"], r["repeat"]): r["importance"] for r in importance.label_importance(shaped, model, rows, ["a", "b"], "id", 2).collect()}
    right = sum((a > 4) == y for _, a, _, y in table) / 120
    assert right == 1
    for repeat in range(2):
        order = sorted(range(120), key=lambda i: (_draw(i, repeat), i))
        moved = sum((table[order[i]][1] > 4) == table[i][3] for i in range(120)) / 120
        assert got["a", repeat] == round(right - moved, 6) and got["b", repeat] == 0


def _draw(key: int, repeat: int) -> int:
    import hashlib

    return int(hashlib.md5(f"{42 + repeat}:shuffle:row:{key}".encode()).hexdigest()[:8], 16)
