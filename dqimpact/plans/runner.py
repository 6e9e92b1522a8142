"""From experiment configs to stored result rows.

A config is planned before anything runs: each of its experiments becomes tasks, each task knows which of
its models are functions of sums (all their cells come from one pass over the training rows) and which
ones need a fit of their own.  What cannot be run is named with a reason and left out; the rest runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from dqimpact.operators.encode import split
from dqimpact.operators.inject import DUPLICATE, ERROR_NAMES, LABELS, MISSING, NOISE, OUTLIER, levels
from dqimpact.operators.moments import FITS
from dqimpact.plans.learners import NAMES, ml_sweep
from dqimpact.plans.sweep import Task, moment_sweep
from dqimpact.sources.config import ROLE_SPELLINGS, Config, Experiment, FeatureSpec, read_configs, to_config
from dqimpact.sources.tables import align, load_results, save_results

STANDARD = "standard"
# Roles whose values must be numbers.
NUMERIC = ("discrete", "continous", "categoricalInteger")
# Roles that an error has values for.
SERVED = {
    NOISE: ("discrete", "continous", "categoricalString", "categoricalInteger", "binary"),
    OUTLIER: ("discrete", "continous", "categoricalString", "categoricalInteger"),
    MISSING: ("discrete", "continous", "categoricalString", "categoricalInteger", "binary"),
}


@dataclass(frozen=True)
class Skipped:
    """Something a config asks for that is not run."""

    error: str | None
    what: str
    reason: str


@dataclass(frozen=True)
class Plan:
    """What a config comes to on a table."""

    dataset: str
    spec: FeatureSpec | None
    baseline: tuple[str, ...]
    tasks: tuple[Task, ...]
    skipped: tuple[Skipped, ...]

    def part(self, codes: Iterable[str]) -> tuple[list[Task], tuple[str, ...]]:
        """Tasks and baseline models restricted to some model codes."""
        codes = set(codes)
        tasks = [replace(t, models=tuple(m for m in t.models if m in codes)) for t in self.tasks]
        return [t for t in tasks if t.models], tuple(m for m in self.baseline if m in codes)


class _Planner:
    def __init__(self, config: Config, schema: T.StructType) -> None:
        self.config, self.types = config, {f.name: f.dataType for f in schema.fields}
        self.skipped: dict[Skipped, None] = {}
        self.tasks: dict[tuple, Task] = {}
        self.baseline: dict[str, None] = {}

    def skip(self, error: str | None, what: str, reason: str) -> None:
        self.skipped[Skipped(error, what, reason)] = None

    def usable(self, error: str | None, feature: str, role: str) -> bool:
        """Whether the table has such a column, of a type that goes with the role."""
        dtype = self.types.get(feature)
        if dtype is None:
            self.skip(error, feature, "no such column")
        elif feature == self.config.spec.target:
            self.skip(error, feature, "the target is no feature")
        elif role in NUMERIC and not isinstance(dtype, T.NumericType):
            self.skip(error, feature, f"a {role} feature must be a number")
        elif role == "binary" and not isinstance(dtype, (T.NumericType, T.BooleanType)):
            self.skip(error, feature, "a binary feature must be a number")
        elif role == "categoricalString" and not isinstance(dtype, T.StringType):
            self.skip(error, feature, "a categoricalString feature must be text")
        else:
            return True
        return False

    def models(self, e: Experiment) -> tuple[str, ...]:
        """Its own models, or those of the config, as far as there are learners for them."""
        wanted = dict.fromkeys(self.config.models if e.models is None else e.models)
        for code in wanted:
            if code not in FITS and code not in NAMES:
                self.skip(e.error, code, "no learner for this model")
        return tuple(code for code in wanted if code in FITS or code in NAMES)

    def add(self, e: Experiment, feature: str, role: str, models: Sequence[str], value: int | None = None) -> None:
        """One task; what an earlier experiment asks for already is not run again."""
        try:
            steps = tuple(levels(0.2 if e.step is None else e.step))
        except ValueError as error:
            self.skip(e.error, feature, str(error))
            return
        if not models or not steps:
            self.skip(e.error, feature, "no models" if steps else "no level below 1")
            return
        key = e.error, feature, role, steps, value
        known = self.tasks.get(key)
        merged = tuple(dict.fromkeys((*(known.models if known else ()), *models)))
        self.tasks[key] = Task(e.error, feature, role, steps, merged, value)

    def experiment(self, e: Experiment) -> None:
        target = self.config.spec.target
        if e.error == STANDARD:
            self.baseline.update(dict.fromkeys(self.models(e)))
        elif e.error in (LABELS, DUPLICATE):
            value = None
            if e.error == DUPLICATE and e.case != "all" and e.target_value is not None:
                try:
                    value = int(float(e.target_value))
                except ValueError:
                    self.skip(e.error, e.target_value, "a class of the target must be 0 or 1")
                    return
            self.add(e, target, "target", self.models(e), value)
        elif e.error not in ERROR_NAMES:
            self.skip(e.error, str(e.role or ""), "no such error")
        else:
            self.on_features(e)

    def on_features(self, e: Experiment) -> None:
        models, spec = self.models(e), self.config.spec
        role = ROLE_SPELLINGS.get(e.role, e.role)
        if e.features is None and role is None:
            named = [(f, spec.role_of(f)) for f in spec.features]
        elif e.features is None:
            named = [(f, role) for f in spec.role(role)]
        else:
            known = {f: spec.role_of(f) for f in spec.features}
            named = [(f, role or known.get(f)) for f in dict.fromkeys(e.features)]
        for feature, kind in named:
            if kind is None:
                self.skip(e.error, feature, "no role")
            elif kind not in SERVED[e.error]:
                self.skip(e.error, feature, f"no {e.error} error for {kind} features")
            elif self.usable(e.error, feature, kind):
                self.add(e, feature, kind, models)


def plan_config(config: Config, schema: T.StructType) -> Plan:
    """The tasks of a config on a table with this schema."""
    planner = _Planner(config, schema)
    target = planner.types.get(config.spec.target)
    if not isinstance(target, (T.NumericType, T.BooleanType)):
        reason = "no such column" if target is None else "the target must be 0 or 1"
        planner.skip(None, config.spec.target, reason)
        return Plan(config.dataset, None, (), (), tuple(planner.skipped))
    roles, seen = {}, set()
    for role, names in config.spec.roles.items():
        kept = [f for f in dict.fromkeys(names) if f not in seen and planner.usable(None, f, role)]
        seen.update(kept)
        roles[role] = tuple(kept)
    for experiment in config.experiments:
        planner.experiment(experiment)
    spec = FeatureSpec(config.spec.target, roles)
    if not spec.features:
        planner.skip(None, config.dataset or "", "no usable features")
        return Plan(config.dataset, None, (), (), tuple(planner.skipped))
    return Plan(config.dataset, spec, tuple(planner.baseline), tuple(planner.tasks.values()), tuple(planner.skipped))


def plan_row(row: Row, schema: T.StructType) -> Plan:
    """The plan of one row of `read_configs`; a config without a target comes to nothing, with the reason."""
    if not row["targetVariable"]:
        named = Skipped(None, str(row["datasetName"]), "the config names no target")
        return Plan(row["datasetName"], None, (), (), (named,))
    return plan_config(to_config(row), schema)


def run_plan(plan: Plan, train: DataFrame, test: DataFrame, key: str, seed: int = 42) -> DataFrame | None:
    """Result rows of all cells of a plan; None if it has none."""
    found = None
    for codes, sweep in ((FITS, moment_sweep), (NAMES, ml_sweep)):
        tasks, baseline = plan.part(codes)
        if tasks or baseline:
            rows = sweep(train, test, plan.spec, tasks, key, plan.dataset, baseline, seed=seed)
            found = rows if found is None else found.unionByName(rows)
    return found


def run_configs(
    spark: SparkSession, configs: str, results: str, read: Callable[[str], DataFrame], key: str, seed: int = 42
) -> list[Skipped]:
    """Run all configs of a path and store their result rows, one folder for each dataset.

    `read` gives the table of a dataset name.  A config with a separate test set is scored on it; else a
    fifth of the rows is held out.  Configs of the same dataset are put together, and a rerun replaces the
    results of its datasets only.  Returns what was not run.
    """
    by_dataset: dict[str, list[Row]] = {}
    for row in read_configs(spark, configs).collect():
        by_dataset.setdefault(row["datasetName"], []).append(row)
    skipped: list[Skipped] = []
    for dataset, rows in by_dataset.items():
        table, found = read(dataset), None
        for row in rows:
            plan = plan_row(row, table.schema)
            skipped += plan.skipped
            if plan.spec is None:
                continue
            train, test = (table, align(read(row["testset"]), table)) if row["testset"] else split(table, key)
            made = run_plan(plan, train, test, key, seed)
            if made is not None:
                found = made if found is None else found.unionByName(made)
        if found is not None:
            save_results(found.distinct(), results)
    return skipped


def run_study(spark: SparkSession, configs: str, results: str, read: Callable[[str], DataFrame], key: str) -> DataFrame:
    """Run the configs and read the stored rows back: what EPC and the warehouse start from."""
    run_configs(spark, configs, results, read, key)
    return load_results(spark, results)
