"""Document rates that bring a corpus to target weights of its domains, with native expressions only.

A classifier held as a table, learned from labelled rows, gives every document a posterior over the
domains.  With t tokens and posterior p a document brings t * p tokens to the domains in expectation, and
the rates r >= 0 are sought for which sum(r * t * p) meets the targets: least squares by projected
gradient from rates of 1, the residual scaled by an inverse Gram matrix sum(t * p * p').

A step takes the Gram matrix of the documents that are free to move (those with a rate, or that the gradient
raises): without a new zero it ends at the targets at once.  One aggregate tries this step at several lengths
together with the plain one over the Gram matrix of all documents, whose length is one, and the best of them is
taken.  The rates are an expression of the steps so far, stored now and then, so a scan of the posteriors sends
a few sums to the driver and nothing else.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqimpact.llm.store import stored

# White space between words.
SPACE = " \t\n\u000b\f\r"
SPACES = "[ \\t-\\r]+"

# Buckets of the words in the table of the classifier, and the labelled rows that it is fitted on at most:
# those whose ids have the smallest hashes.
BUCKETS = 16_384
MAX_LABELLED = 20_000


@dataclass(frozen=True)
class Classifier:
    """Buckets of the table, labelled rows to fit it on at most, and which buckets weigh.

    A bucket weighs if a domain has it in `least` labelled rows, and `surprise` standard deviations more or less
    often than by its share of all buckets; by default all do.
    """

    buckets: int = BUCKETS
    max_labelled: int = MAX_LABELLED
    surprise: float = 0.0
    least: int = 0


#: For some hundred labelled rows or more of each domain: the few words that mark one do not drown in all others.
TELLING = Classifier(buckets=65_536, surprise=5.0, least=5)


@dataclass(frozen=True)
class Solver:
    """When the steps end: at a residual, or at a mean move of the plain projected step, of `tolerance`.

    The residual is the largest of a domain as a share of all tokens; without a move the rates are a least-squares
    solution, whether or not it meets the targets.  After `max_steps`, or `patience` steps that lower the
    residual by less than a hundredth, the targets count as not to be met.
    """

    tolerance: float = 1e-9
    max_steps: int = 60
    patience: int = 8
    lengths: tuple[float, ...] = (1.0, 0.5, 0.25, 0.0625)
    # Steps after which the rates are stored.
    stored_after: int = 8


def words_of(text: Column) -> Column:
    whole = F.coalesce(text.cast("string"), F.lit(""))
    none = F.array().cast("array<string>")
    return F.when(whole.rlike("[^ \\t-\\r]"), F.split(F.btrim(F.lower(whole), F.lit(SPACE)), SPACES)).otherwise(none)


def _featured(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    """Add n_tokens and the distinct buckets of the words of each row."""
    split = docs.withColumn("_words", words_of(F.col(text)))
    places = F.transform("_words", lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    return split.select(
        *docs.columns, F.size("_words").cast("long").alias("n_tokens"), F.array_distinct(places).alias("_buckets")
    )


def domain_of(labels: DataFrame) -> DataFrame:
    """doc_id and domain of the labelled rows: toxic, clean or junk."""
    known = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").otherwise("junk")
    return known.select("doc_id", domain.alias("domain"))


def fit(
    docs: DataFrame, labelled: DataFrame, domains: Sequence[str], text: str = "text", buckets: int = BUCKETS,
    max_labelled: int = MAX_LABELLED, surprise: float = 0.0, least: int = 0,
) -> tuple[list[float], list[list[float]]]:
    """Log priors and, for each domain, log weights of the buckets, both against the first domain.

    Naive Bayes over the buckets that occur in a document.  `labelled` has doc_id and domain; at most
    `max_labelled` of its rows are used.  Buckets below `surprise` and `least` weigh nothing.  The result has a
    fixed size.
    """
    import math

    sample = labelled.orderBy(F.xxhash64("doc_id"), "domain").limit(max_labelled)
    met = docs.select("doc_id", text).join(F.broadcast(sample), "doc_id")
    seen = _featured(met, text, buckets).select("domain", F.explode("_buckets").alias("bucket"))
    counts = seen.groupBy("bucket", "domain").agg(F.count(F.lit(1)).alias("n")).collect()
    rows = {r["domain"]: r["n"] for r in met.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = {d: [0] * buckets for d in domains}
    for row in counts:
        if row["domain"] in table:
            table[row["domain"]][row["bucket"]] += row["n"]
    sums = {d: sum(table[d]) for d in domains}
    whole = sum(sums.values())

    def telling(bucket: int) -> bool:
        if not surprise:
            return True
        own = [table[d][bucket] for d in domains]
        if max(own) < max(least, 1):
            return False
        expected = [sum(own) * sums[d] / whole for d in domains]
        spread = [math.sqrt(e * (1 - sums[d] / whole)) for e, d in zip(expected, domains, strict=True)]
        return any(abs(n - e) >= surprise * s > 0 for n, e, s in zip(own, expected, spread, strict=True))

    chosen = [telling(b) for b in range(buckets)]
    logs = {d: [math.log(x + 0.5) - math.log(sums[d] + 0.5 * buckets) for x in table[d]] for d in domains}
    total = sum(rows.get(d, 0) + 1 for d in domains)
    priors = [math.log((rows.get(d, 0) + 1) / total) for d in domains]
    weights = [
        [x - y if tells else 0.0 for x, y, tells in zip(logs[d], logs[domains[0]], chosen, strict=True)] for d in domains
    ]
    return [p - priors[0] for p in priors], weights


def _held(weights: list[float]) -> Column:
    """The weights as one literal array, made when the plan is made."""
    return F.split(F.lit(",".join(repr(w) if w else "0" for w in weights)), ",").cast("array<double>")


def _weighed(buckets: Column, weights: list[float]) -> Column:
    """The sum of the weights of some buckets."""
    held = _held(weights)
    return F.aggregate(buckets, F.lit(0.0), lambda total, bucket: total + held[bucket])


def with_posteriors(docs: DataFrame, model: tuple[list[float], list[list[float]]], domains: Sequence[str], text: str = "text") -> DataFrame:
    """Add n_tokens and p_<domain> to every row.

    The words of a text depend on each other, so the sum of their weights is divided by the square root
    of the number of those with a weight before it meets the prior.
    """
    priors, weights = model
    rows = _featured(docs, text, len(weights[0]))
    if not all(map(any, zip(*weights, strict=True))):
        held = [_held(w) for w in weights[1:]]
        rows = rows.withColumn("_buckets", F.filter("_buckets", lambda b: reduce(lambda x, y: x | y, [h[b] != 0 for h in held])))
    damped = F.greatest(F.sqrt(F.size("_buckets")), F.lit(1.0))
    scores = {"_score_0": F.lit(0.0)}
    for k in range(1, len(domains)):
        scores[f"_score_{k}"] = F.lit(priors[k]) + _weighed(F.col("_buckets"), weights[k]) / damped
    rows = rows.withColumns(scores)
    top = F.greatest(*[F.col(c) for c in scores])
    rows = rows.withColumns({f"_e{k}": F.exp(F.col(c) - top) for k, c in enumerate(scores)})
    whole = sum((F.col(f"_e{k}") for k in range(1, len(domains))), F.col("_e0"))
    made = [(F.col(f"_e{k}") / whole).alias(f"p_{d}") for k, d in enumerate(domains)]
    return rows.select(*docs.columns, "n_tokens", *made)


def _solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """A small linear system; a domain that no document belongs to gets a pivot of its own."""
    n = len(right)
    rows = [[*matrix[i], right[i]] for i in range(n)]
    scale = max((rows[i][i] for i in range(n)), default=0.0) or 1.0
    for i in range(n):
        rows[i][i] += 1e-12 * scale
    for i in range(n):
        pivot = max(range(i, n), key=lambda k: abs(rows[k][i]))
        rows[i], rows[pivot] = rows[pivot], rows[i]
        for k in range(n):
            if k != i:
                factor = rows[k][i] / rows[i][i]
                rows[k] = [a - factor * b for a, b in zip(rows[k], rows[i], strict=True)]
    return [rows[i][n] / rows[i][i] for i in range(n)]


def with_rates(rows: DataFrame, targets: Mapping[str, float], solver: Solver = Solver()) -> DataFrame:
    """Add `rate` to rows that have n_tokens and p_<domain>; `targets` are shares of all tokens.

    `missed` is the largest residual of a domain as a share of all tokens, the same in all rows: within the
    tolerance of the solver, or else a warning tells that the targets were not met.
    `rows` should be a stored table, for it is read twice for each step.
    """
    domains = list(targets)
    p = [F.col(f"p_{d}") for d in domains]
    shares = sum(targets.values())
    total = rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("double")).first()[0]
    wanted = [total * targets[d] / shares for d in domains]
    slim = rows.select("n_tokens", *[x.alias(f"_p{k}") for k, x in enumerate(p)])
    steps, missed = _steps(slim, wanted, total, solver) if total else ([], 0.0)
    if missed > solver.tolerance:
        warnings.warn(f"targets {dict(targets)} missed by {missed:.3g} of all tokens", stacklevel=2)
    rate = reduce(lambda r, step: _moved(r, p, step), steps, F.lit(1.0))
    return rows.withColumn("rate", rate).withColumn("missed", F.lit(missed))


def _dot(left: Sequence, right: Sequence):
    return sum((x * y for x, y in zip(left[1:], right[1:], strict=True)), left[0] * right[0])


def _along(p: Sequence[Column], step: Sequence[float]) -> Column:
    return _dot(p, [F.lit(float(x)) for x in step])


def _moved(rate: Column, p: Sequence[Column], step: Sequence[float]) -> Column:
    """The rate after a step, projected to 0 or more."""
    return F.greatest(F.lit(0.0), rate - _along(p, step))


def _steps(slim: DataFrame, wanted: Sequence[float], total: float, solver: Solver) -> tuple[list[list[float]], float]:
    """The steps taken one after another from rates of 1, and the share of all tokens that the last rates miss."""
    n = len(wanted)
    p = [F.col(f"_p{k}") for k in range(n)]
    pairs = [(i, k) for i in range(n) for k in range(i, n)]
    tokens = F.col("n_tokens")

    def gram(sums: Sequence[float]) -> list[list[float]]:
        found = dict(zip(pairs, sums, strict=True))
        return [[found[min(i, k), max(i, k)] for k in range(n)] for i in range(n)]

    def residuals(tried: Sequence[Column]) -> list[list[float]]:
        sums = at.agg(*[F.sum(tokens * rate * x) for rate in tried for x in p]).first()
        return [[sums[j * n + k] - wanted[k] for k in range(n)] for j in range(len(tried))]

    def value(residual: Sequence[float]) -> float:
        return _dot(residual, _solved(whole, residual))

    at = slim.withColumn("_rate", F.lit(1.0))
    whole = gram(at.agg(*[F.sum(tokens * p[i] * p[k]) for i, k in pairs]).first())
    # A domain that nearly no document belongs to would have nearly all the weight.
    whole = [[g + (1e-5 * total if i == k else 0.0) for k, g in enumerate(line)] for i, line in enumerate(whole)]
    rate, (residual,) = F.col("_rate"), residuals([F.col("_rate")])
    steps: list[list[float]] = []
    idle = 0
    while True:
        missed = max(map(abs, residual)) / total
        if missed <= solver.tolerance or len(steps) >= solver.max_steps or idle >= solver.patience:
            return steps, missed
        plain = _solved(whole, residual)
        free = F.when((rate > 0) | (_along(p, plain) < 0), tokens).otherwise(0)
        *sums, move = at.agg(
            *[F.sum(free * p[i] * p[k]) for i, k in pairs], F.sum(tokens * F.abs(rate - _moved(rate, p, plain)))
        ).first()
        if move / total <= solver.tolerance:
            return steps, missed
        newer = _solved(gram(sums), residual)
        tried = [plain, *[[length * x for x in newer] for length in solver.lengths]]
        left = residuals([_moved(rate, p, step) for step in tried])
        best = min(range(len(tried)), key=lambda k: value(left[k]))
        before, after = value(residual), value(left[best])
        if after >= before:
            # Below the precision of the sums.
            return steps, missed
        idle = idle + 1 if after > 0.99 * before else 0
        steps.append(tried[best])
        rate, residual = _moved(rate, p, tried[best]), left[best]
        if len(steps) % solver.stored_after == 0:
            at = stored(at.withColumn("_rate", rate), "rates")
            rate = F.col("_rate")


def copies(rate: Column, key: Column) -> Column:
    """How often a document is taken: the rate, rounded up or down by a draw that its key fixes."""
    draw = F.pmod(F.xxhash64(F.lit("copies"), key), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + draw).cast("int")


#: Shares of the tokens of the mixed corpus.
TARGETS = {"clean": 0.9, "junk": 0.02, "toxic": 0.08}


def profile(rows: DataFrame, domain: str, domains: Sequence[str]) -> dict[str, float] | None:
    """What the documents that most likely belong to one domain bring to all domains, as shares of their tokens.

    As targets these can be met by any posteriors: by rates of 0 for all other documents.  None without such documents.
    """
    top = F.greatest(*[F.col(f"p_{d}") for d in domains])
    own = rows.filter((F.col(f"p_{domain}") == top) & (F.col("n_tokens") > 0))
    sums = own.agg(*[F.sum(F.col("n_tokens") * F.col(f"p_{d}")) for d in domains]).first()
    return None if sums[0] is None else {d: x / sum(sums) for d, x in zip(domains, sums, strict=True)}


def mixing_rates(
    docs: DataFrame,
    labels: DataFrame,
    targets: Mapping[str, float] = TARGETS,
    keep: Sequence[str] = (),
    text: str = "text",
    like: str | None = None,
    classifier: Classifier = Classifier(),
) -> DataFrame:
    """doc_id, the columns in `keep`, n_tokens, p_<domain>, rate and missed of every row of `docs`.

    With `like`, the name of a domain, the targets are the profile of the documents that most likely belong to
    it; `targets` then only names the domains, and stands in where there is no such document.

    Defined results for odd rows: a null or empty text has no tokens and the posterior of the priors;
    labels with a null are left out, and of several labels of one document each counts; without labels
    all domains are equally likely; repeated rows get equal rates; an empty table gives an empty result;
    further columns are left out, and a column in `keep` that has the name of a computed one gives way to it.
    """
    domains = list(targets)
    made = ["n_tokens", *[f"p_{d}" for d in domains]]
    taken = {c.lower() for c in [*made, "rate", "missed"]}
    own = [c for c in dict.fromkeys(["doc_id", *keep]) if c.lower() not in taken]
    quoted = ["`" + c.replace("`", "``") + "`" for c in own]
    model = fit(
        docs, domain_of(labels), domains, text, classifier.buckets, classifier.max_labelled, classifier.surprise, classifier.least
    )
    # The caller's columns have other names meanwhile, which cannot clash with those made on the way.
    plain = docs.select(F.col(text).alias("text"), *[F.col(c).alias(f"own{i}") for i, c in enumerate(quoted)])
    judged = with_posteriors(plain, model, domains)
    rows = stored(judged.select(*[f"own{i}" for i in range(len(own))], *made), "posteriors")
    goal = profile(rows, like, domains) if like else None
    rated = with_rates(rows, goal or targets)
    return rated.select(*[F.col(f"own{i}").alias(c) for i, c in enumerate(own)], *made, "rate", "missed")
