"""Associations between features and target, and between features."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqimpact.functions.stats import pearson, rounded
from dqimpact.operators import correlate, inject, metrics
from dqimpact.queries import LEVELS_SQL, Query, sql_rounded, sql_share, table
from dqimpact.sources.config import FeatureSpec

DIGITS = 6

ITEM_SPEC = FeatureSpec(
    "returned",
    {
        "continous": ("l_extendedprice", "l_tax"),
        "discrete": ("l_quantity",),
        "categoricalString": ("supplier_group",),
        "categoricalInteger": ("l_linenumber",),
        "binary": ("open", "discounted"),
    },
)
DOCUMENT_SPEC = FeatureSpec(
    "quality",
    {"discrete": ("n_chars",), "categoricalString": ("lang", "source"), "binary": ("toxic",)},
)


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return documents.join(table(spark, folder, "labels"), "doc_id")


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with a 0/1 target and features of every role."""
    return table(spark, folder, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("returned"),
        "l_extendedprice",
        "l_tax",
        "l_quantity",
        F.concat("l_returnflag", F.lit("-"), (F.col("l_suppkey") % 7).cast("string")).alias("supplier_group"),
        "l_linenumber",
        (F.col("l_linestatus") == "O").cast("int").alias("open"),
        (F.col("l_discount") > 0.05).cast("int").alias("discounted"),
    )


ITEMS_SQL = """items as (select (l_returnflag = 'R')::int as returned, l_extendedprice, l_tax, l_quantity,
  l_returnflag || '-' || (l_suppkey % 7)::varchar as supplier_group, l_linenumber,
  (l_linestatus = 'O')::int as "open", (l_discount > 0.05)::int as discounted from lineitem)"""
DOCUMENTS_SQL = "docs as (select doc_id, lang, source, n_chars, quality, toxic from documents join labels using (doc_id))"


def _values(name: str) -> object:
    return rounded(F.col(name), DIGITS).alias(name)


def point_biserial(spark: SparkSession, folder: str) -> DataFrame:
    data = items(spark, folder)
    return data.agg(
        *[
            rounded(pearson(c, "returned"), DIGITS).alias(c)
            for c in ("l_extendedprice", "l_tax", "l_quantity")
        ]
    )


def contingency(spark: SparkSession, folder: str) -> DataFrame:
    return correlate.contingency(items(spark, folder), "supplier_group", "l_linenumber")


def chi_square(spark: SparkSession, folder: str) -> DataFrame:
    found = correlate.chi_square(items(spark, folder), "supplier_group", "l_linenumber")
    return found.select(rounded(F.col("chi2"), 4).alias("chi2"), "n", "row_levels", "column_levels")


def chi_square_2x2(spark: SparkSession, folder: str) -> DataFrame:
    found = correlate.chi_square(items(spark, folder), "open", "returned")
    return found.select(rounded(F.col("chi2"), 4).alias("chi2"), "n", "row_levels", "column_levels")


def cramers_v(spark: SparkSession, folder: str) -> DataFrame:
    return correlate.cramers_v_of(items(spark, folder), "supplier_group", "returned").select(_values("cramers_v"))


def mcc(spark: SparkSession, folder: str) -> DataFrame:
    spec = FeatureSpec("returned", {"binary": ("open", "discounted")})
    found = correlate.target_correlations(items(spark, folder).select("returned", "open", "discounted"), spec)
    return found.select("Feature", "Type", _values("Correlation"))


def spearman(spark: SparkSession, folder: str) -> DataFrame:
    pairs = [("l_extendedprice", "l_quantity"), ("l_quantity", "l_tax")]
    return correlate.spearman_pairs(items(spark, folder), pairs).select(
        "Feature1", "Feature2", _values("Correlation")
    )


def phi(spark: SparkSession, folder: str) -> DataFrame:
    found = correlate.phi_pairs(items(spark, folder), [("open", "discounted"), ("open", "returned")])
    return found.select("Feature1", "Feature2", _values("Correlation"))


def group_mean_variance(spark: SparkSession, folder: str) -> DataFrame:
    pairs = [("l_extendedprice", "supplier_group"), ("l_quantity", "l_linenumber")]
    found = correlate.group_mean_variance(items(spark, folder), pairs, {"supplier_group", "l_linenumber"})
    return found.select("Feature1", "Feature2", rounded(F.col("Correlation"), 4).alias("Correlation"))


def target_correlations(spark: SparkSession, folder: str) -> DataFrame:
    found = correlate.target_correlations(labelled_documents(spark, folder).drop("doc_id"), DOCUMENT_SPEC)
    return found.select("Feature", "Role", "Type", _values("Correlation"), "relevant")


def class_target_correlations(spark: SparkSession, folder: str) -> DataFrame:
    """A target with four classes."""
    data = items(spark, folder).withColumn("kind", F.col("l_linenumber") % 4).select("kind", "supplier_group", "l_tax")
    spec = FeatureSpec("kind", {"continous": ("l_tax",), "categoricalString": ("supplier_group",)})
    return correlate.target_correlations(data, spec).select("Feature", "Type", _values("Correlation"))


GAPPY_SQL = """gappy as (select case when l_suppkey % 5 <> 0 then l_returnflag end as flag,
  case when l_partkey % 7 <> 0 then l_linestatus end as status, l_quantity from lineitem)"""


def null_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Missing texts are a level of their own."""
    data = table(spark, folder, "lineitem").select(
        F.when(F.col("l_suppkey") % 5 != 0, F.col("l_returnflag")).alias("flag"),
        F.when(F.col("l_partkey") % 7 != 0, F.col("l_linestatus")).alias("status"),
        "l_quantity",
    )
    v = correlate.cramers_v_pairs(data, [("flag", "status")])
    means = correlate.group_mean_variance(data, [("l_quantity", "flag")], {"flag"})
    return v.unionByName(means).select("Feature1", "Feature2", _values("Correlation"))


def item_target_correlations(spark: SparkSession, folder: str) -> DataFrame:
    found = correlate.target_correlations(items(spark, folder), ITEM_SPEC)
    return found.select("Feature", "Role", "Type", _values("Correlation"), "relevant")


def pairwise_correlations(spark: SparkSession, folder: str) -> DataFrame:
    found = correlate.pairwise_correlations(items(spark, folder), ITEM_SPEC)
    return found.select(
        "Feature1", "Feature2", "Type", rounded(F.col("Correlation"), 4).alias("Correlation")
    )


def numeric_target_correlation(spark: SparkSession, folder: str) -> DataFrame:
    data = labelled_documents(spark, folder).drop("doc_id")
    return correlate.numeric_target_correlations(data, "quality").select("Feature", _values("Correlation"))


MI_SPEC = FeatureSpec(
    "returned",
    {
        "continous": ("l_extendedprice",),
        "discrete": ("l_quantity",),
        "categoricalString": ("supplier_group",),
        "categoricalInteger": ("l_linenumber",),
        "binary": ("open",),
    },
)


def mutual_information(spark: SparkSession, folder: str) -> DataFrame:
    found = correlate.mutual_information(items(spark, folder), MI_SPEC, bins=10, equal_width=True)
    return found.select("Feature", _values("Score"))


def mutual_information_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    found = correlate.mutual_information(items(spark, folder), MI_SPEC, bins=10)
    return found.select("Feature", _values("Score"))


def correlation_after_error(spark: SparkSession, folder: str) -> DataFrame:
    """How each association weakens as its feature gets noisier."""
    data = labelled_documents(spark, folder)
    steps = inject.levels(0.2)
    noisy = inject.inject_levels(data, "toxic", "binary", "noise", steps, "doc_id")
    parts = [correlate.correlation_after_error(noisy, "toxic", "binary", "quality")]
    noisy = inject.inject_levels(data, "n_chars", "discrete", "noise", steps, "doc_id")
    parts.append(correlate.correlation_after_error(noisy, "n_chars", "discrete", "quality"))
    noisy = inject.inject_levels(data, "lang", "categoricalString", "noise", steps, "doc_id")
    parts.append(correlate.correlation_after_error(noisy, "lang", "categoricalString", "quality"))
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.select("percentage", "Feature", _values("Correlation"), "Correlation Type")


def binary_metrics(spark: SparkSession, folder: str) -> DataFrame:
    data = labelled_documents(spark, folder).withColumn("guess", (F.col("n_chars") > 1000).cast("int"))
    return metrics.binary_metrics(data, "quality", "guess", by=["lang"])


def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    data = labelled_documents(spark, folder).withColumn("score", F.col("n_chars") / F.lit(100000.0))
    return metrics.roc_auc(data, "quality", "score", by=["lang"], digits=DIGITS)


def item_roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.roc_auc(items(spark, folder), "returned", "l_extendedprice", digits=DIGITS)


QUERIES: dict[str, Query] = {
    "point_biserial": point_biserial,
    "contingency": contingency,
    "chi_square": chi_square,
    "chi_square_2x2": chi_square_2x2,
    "cramers_v": cramers_v,
    "mcc": mcc,
    "spearman": spearman,
    "phi": phi,
    "group_mean_variance": group_mean_variance,
    "target_correlations": target_correlations,
    "item_target_correlations": item_target_correlations,
    "class_target_correlations": class_target_correlations,
    "null_categories": null_categories,
    "pairwise_correlations": pairwise_correlations,
    "numeric_target_correlation": numeric_target_correlation,
    "mutual_information": mutual_information,
    "mutual_information_quantiles": mutual_information_quantiles,
    "correlation_after_error": correlation_after_error,
    "binary_metrics": binary_metrics,
    "roc_auc": roc_auc,
    "item_roc_auc": item_roc_auc,
}


def _sql_corr(x: str, y: str, digits: int = DIGITS) -> str:
    return sql_rounded(f"corr({x}, {y})", digits)


def _sql_chi2(source: str, a: str, b: str) -> str:
    """CTEs ending in one row `st` (chi2, n, r, k) from the full grid of levels."""
    return f"""c as (select {a} as a, {b} as b, count(*) as n from {source} group by 1, 2),
      ra as (select a, sum(n)::double as ra from c group by a), rb as (select b, sum(n)::double as rb from c group by b),
      t as (select sum(n)::double as n from c),
      d as (select (select count(*) from ra) as r, (select count(*) from rb) as k),
      g as (select ra * rb / t.n as e, abs(coalesce(c.n, 0) - ra * rb / t.n) as gap from ra cross join rb cross join t
            left join c on c.a = ra.a and c.b = rb.b),
      st as (select sum(case when d.r = 2 and d.k = 2 then (gap - least(0.5, gap)) * (gap - least(0.5, gap)) / e
                        else gap * gap / e end) as chi2, max(t.n) as n, max(d.r) as r, max(d.k) as k from g, d, t)"""


V_SQL = """sqrt(greatest(0, chi2 / n - (k - 1) * (r - 1) / (n - 1))
  / least(k - (k - 1) * (k - 1) / (n - 1) - 1, r - (r - 1) * (r - 1) / (n - 1) - 1))"""


def _sql_v(source: str, a: str, b: str, digits: int = DIGITS) -> str:
    return f"(with {_sql_chi2(source, a, b)} select {sql_rounded(V_SQL, digits)} from st)"


def _sql_mcc(a: str, b: str) -> str:
    """Matthews coefficient of two 0/1 columns, as an aggregate."""
    tp, tn = f"sum({a} * {b})::double", f"sum((1 - {a}) * (1 - {b}))::double"
    fp, fn = f"sum({a} * (1 - {b}))::double", f"sum((1 - {a}) * {b})::double"
    value = f"(({tp}) * ({tn}) - ({fp}) * ({fn})) / sqrt((({tp}) + ({fp})) * (({tp}) + ({fn})) * (({tn}) + ({fp})) * (({tn}) + ({fn})))"
    return sql_rounded(value, DIGITS)


def _sql_spearman(source: str, a: str, b: str, digits: int = DIGITS) -> str:
    return f"""(select {_sql_corr('ra', 'rb', digits)} from (select
      rank() over (order by {a}) + (count(*) over (partition by {a}) - 1) / 2.0 as ra,
      rank() over (order by {b}) + (count(*) over (partition by {b}) - 1) / 2.0 as rb from {source}))"""


def _sql_group_variance(source: str, number: str, category: str) -> str:
    return f"""(select {sql_rounded('var_samp(m)', 4)} from
      (select avg({number}) as m from {source} group by {category}))"""


def _target_row(feature: str, role: str, kind: str, value: str) -> str:
    return f"""select '{feature}' as "Feature", '{role}' as "Role", '{kind}' as "Type", {value} as "Correlation" """


def _target_rows(source: str, rows: list[str]) -> str:
    return f"""select *, abs("Correlation") >= 0.5 as relevant from ({' union all '.join(rows)}) w
      where "Correlation" is not null"""


def _pair_rows() -> str:
    order = ["l_extendedprice", "l_tax", "l_quantity", "supplier_group", "l_linenumber", "open", "discounted"]
    numbers, categories = set(order[:3]), set(order[3:5])
    rows = []
    for a, b in combinations(order, 2):
        qa, qb = f'"{a}"', f'"{b}"'
        if not {a, b} & (numbers | categories):
            kind, value = correlate.PHI, f"(select {_sql_corr(qa, qb, 4)} from items)"
        elif {a, b} <= categories or ({a, b} & categories and not {a, b} & numbers):
            kind, value = correlate.CRAMERS_V, _sql_v("items", qa, qb, 4)
        elif {a, b} & categories:
            number, category = (qb, qa) if a in categories else (qa, qb)
            kind, value = correlate.ANOVA, _sql_group_variance("items", number, category)
        else:
            kind, value = correlate.SPEARMAN, _sql_spearman("items", qa, qb, 4)
        kind = kind.replace("'", "''")
        rows.append(f"""select '{a}' as "Feature1", '{b}' as "Feature2", '{kind}' as "Type", {value} as "Correlation" """)
    return " union all ".join(rows)


def _mi_rows(price_bin: str) -> str:
    """Scores of all features; `price_bin` is SQL for the bin of a price."""
    rows = " union all ".join(
        _sql_mi(feature, value)
        for feature, value in {
            "l_extendedprice": price_bin,
            "l_quantity": "l_quantity",
            "supplier_group": "supplier_group",
            "l_linenumber": "l_linenumber",
            "open": '"open"',
        }.items()
    )
    return f"""with {ITEMS_SQL.replace('items as', 'plain_items as', 1)},
        items as (select *, rank() over (order by l_extendedprice) - 1 as below,
          count(l_extendedprice) over () as in_all from plain_items),
        bounds as (select min(l_extendedprice) lo, max(l_extendedprice) hi from items),
        w as ({rows}) select * from w where "Score" is not null"""


def _sql_mi(feature: str, value: str) -> str:
    return f"""select '{feature}' as "Feature", {sql_rounded('sum(n / t * ln(n * t / (v * k)))', DIGITS)} as "Score"
      from (select n, sum(n) over () as t, sum(n) over (partition by x) as v, sum(n) over (partition by y) as k from
        (select {value} as x, returned as y, count(*)::double as n from items, bounds group by 1, 2))"""


CRAMERS_TEXT = correlate.CRAMERS_V.replace("'", "''")
_NOISY = f"""u_t as (select *, {sql_share('noise', 'toxic', 'doc_id')} as ut, {sql_share('noise', 'n_chars', 'doc_id')} as un,
    ('0x' || substr(md5('42:noise:n_chars:' || doc_id || ':v'), 1, 8))::bigint as hn,
    {sql_share('noise', 'lang', 'doc_id')} as ul,
    ('0x' || substr(md5('42:noise:lang:' || doc_id || ':v'), 1, 8))::bigint as hl from docs),
  s as (select min(n_chars) as lo, max(n_chars) as hi, list_sort(list(distinct lang)) as d,
    count(distinct lang) as k_values from docs),
  noisy as (select p, quality, case when ut < p then 1 - toxic else toxic end as toxic,
    case when un < p then lo + hn % (hi - lo + 1) else n_chars end as n_chars,
    case when ul < p then (case when d[(hl % (k_values - 1)) + 1] = lang then d[k_values]
      else d[(hl % (k_values - 1)) + 1] end) else lang end as lang from u_t, s, {LEVELS_SQL})"""


def _v_at(p: float) -> str:
    return _sql_v(f"(select * from noisy where p = {p}::double) np", "lang", "quality")


def _metrics_sql() -> str:
    return f"""with {DOCUMENTS_SQL}, c as (select lang, count(*) filter (where quality = 1 and n_chars > 1000)::double tp,
      count(*) filter (where quality = 0 and n_chars > 1000)::double fp,
      count(*) filter (where quality = 1 and n_chars <= 1000)::double fn,
      count(*) filter (where quality = 0 and n_chars <= 1000)::double tn from docs group by lang)
      select lang, round((tp + tn) / (tp + fp + fn + tn), 4) as "Accuracy",
        round(coalesce(tp / nullif(tp + fn, 0), 0), 4) as "Recall",
        round(coalesce(tp / nullif(tp + fp, 0), 0), 4) as "Precision",
        round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) as "F1" from c"""


def sql_auc(score: str, target: str, group: str, source: str) -> str:
    """SQL for (group, auc) by rank sums with ties counted half."""
    by = f"partition by {group}" if group else ""
    keep = f"{group} as grp, " if group else "1 as grp, "
    return f"""(select grp, (sum(case when y = 1 then r end) - max(n1) * (max(n1) + 1) / 2.0)
        / nullif(max(n1) * max(n0), 0) as auc
      from (select {keep}{target} as y, rank() over ({by} order by {score})
          + (count(*) over (partition by {group + ', ' if group else ''}{score}) - 1) / 2.0 as r,
        sum({target}) over ({by})::double as n1, sum(1 - {target}) over ({by})::double as n0 from {source})
      group by grp)"""


ORACLE: dict[str, str] = {
    "point_biserial": f"""with {ITEMS_SQL} select
        {', '.join(f'{_sql_corr(c, "returned")} as {c}' for c in ("l_extendedprice", "l_tax", "l_quantity"))} from items""",
    "contingency": f"with {ITEMS_SQL} select supplier_group, l_linenumber, count(*) as n from items group by 1, 2",
    "chi_square": f"""with {ITEMS_SQL}, {_sql_chi2('items', 'supplier_group', 'l_linenumber')}
        select round(chi2, 4) as chi2, n::bigint as n, r as row_levels, k as column_levels from st""",
    "chi_square_2x2": f"""with {ITEMS_SQL}, {_sql_chi2('items', '"open"', 'returned')}
        select round(chi2, 4) as chi2, n::bigint as n, r as row_levels, k as column_levels from st""",
    "cramers_v": f"with {ITEMS_SQL} select {_sql_v('items', 'supplier_group', 'returned')} as cramers_v",
    "mcc": f"""with {ITEMS_SQL} select 'open' as "Feature", '{correlate.MATTHEWS}' as "Type",
        {_sql_mcc('"open"', 'returned')} as "Correlation" from items union all
        select 'discounted', '{correlate.MATTHEWS}', {_sql_mcc('discounted', 'returned')} from items""",
    "spearman": f"""with {ITEMS_SQL} select 'l_extendedprice' as "Feature1", 'l_quantity' as "Feature2",
        {_sql_spearman('items', 'l_extendedprice', 'l_quantity')} as "Correlation" union all
        select 'l_quantity', 'l_tax', {_sql_spearman('items', 'l_quantity', 'l_tax')}""",
    "phi": f"""with {ITEMS_SQL} select 'open' as "Feature1", 'discounted' as "Feature2",
        {_sql_corr('"open"', 'discounted')} as "Correlation" from items union all
        select 'open', 'returned', {_sql_corr('"open"', 'returned')} from items""",
    "group_mean_variance": f"""with {ITEMS_SQL} select 'l_extendedprice' as "Feature1", 'supplier_group' as "Feature2",
        {_sql_group_variance('items', 'l_extendedprice', 'supplier_group')} as "Correlation" union all
        select 'l_quantity', 'l_linenumber', {_sql_group_variance('items', 'l_quantity', 'l_linenumber')}""",
    "class_target_correlations": f"""with {ITEMS_SQL},
        kinds as (select l_linenumber % 4 as kind, supplier_group, l_tax from items)
        select 'l_tax' as "Feature", '{correlate.POINT_BISERIAL}' as "Type",
          (select {_sql_corr('l_tax', 'kind')} from kinds) as "Correlation" union all
        select 'supplier_group', '{CRAMERS_TEXT}', {_sql_v('kinds', 'supplier_group', 'kind')}""",
    "null_categories": f"""with {GAPPY_SQL}, named as (select coalesce(flag, 'None') as flag,
          coalesce(status, 'None') as status, l_quantity from gappy)
        select 'flag' as "Feature1", 'status' as "Feature2", {_sql_v('named', 'flag', 'status')} as "Correlation" union all
        select 'l_quantity', 'flag', (select {sql_rounded('var_samp(m)', DIGITS)} from
          (select avg(l_quantity) as m from named group by flag))""",
    "target_correlations": f"with {DOCUMENTS_SQL} "
    + _target_rows(
        "docs",
        [
            _target_row("n_chars", "Discrete", correlate.POINT_BISERIAL, f"(select {_sql_corr('n_chars', 'quality')} from docs)"),
            _target_row("lang", "CategoricalString", CRAMERS_TEXT, _sql_v("docs", "lang", "quality")),
            _target_row("source", "CategoricalString", CRAMERS_TEXT, _sql_v("docs", "source", "quality")),
            _target_row("toxic", "Binary", correlate.MATTHEWS, f"(select {_sql_mcc('toxic', 'quality')} from docs)"),
        ],
    ),
    "item_target_correlations": f"with {ITEMS_SQL} "
    + _target_rows(
        "items",
        [
            _target_row(c, role, correlate.POINT_BISERIAL, f"(select {_sql_corr(c, 'returned')} from items)")
            for c, role in (("l_extendedprice", "Continuous"), ("l_tax", "Continuous"), ("l_quantity", "Discrete"))
        ]
        + [
            _target_row("supplier_group", "CategoricalString", CRAMERS_TEXT, _sql_v("items", "supplier_group", "returned")),
            _target_row("l_linenumber", "CategoricalInt", CRAMERS_TEXT, _sql_v("items", "l_linenumber", "returned")),
        ]
        + [
            _target_row(c, "Binary", correlate.MATTHEWS, f"(select {_sql_mcc(q, 'returned')} from items)")
            for c, q in (("open", '"open"'), ("discounted", "discounted"))
        ],
    ),
    "pairwise_correlations": f"with {ITEMS_SQL} {_pair_rows()}",
    "numeric_target_correlation": f"with {DOCUMENTS_SQL} "
    + " union all ".join(
        f"""select '{c}' as "Feature", {_sql_corr(c, 'quality')} as "Correlation" from docs"""
        for c in ("n_chars", "quality", "toxic")
    ),
    "mutual_information": _mi_rows("least(floor((l_extendedprice - lo) / (hi - lo) * 10), 9)"),
    "mutual_information_quantiles": _mi_rows("floor(below * 10 / in_all)"),
    "correlation_after_error": f"""with {DOCUMENTS_SQL}, {_NOISY}
        select p as percentage, 'toxic' as "Feature", {_sql_mcc('toxic', 'quality')} as "Correlation",
          '{correlate.MATTHEWS}' as "Correlation Type" from noisy group by p union all
        select p, 'n_chars', {_sql_corr('n_chars', 'quality')}, '{correlate.POINT_BISERIAL}' from noisy group by p union all
        {' union all '.join(f"select {p}::double, 'lang', {_v_at(p)}, '{CRAMERS_TEXT}'" for p in (0.2, 0.4, 0.6, 0.8))}""",
    "binary_metrics": _metrics_sql(),
    "roc_auc": f"""with {DOCUMENTS_SQL} select grp as lang, {sql_rounded('auc', DIGITS)} as "Auc"
        from {sql_auc('n_chars', 'quality', 'lang', 'docs')} a""",
    "item_roc_auc": f"""with {ITEMS_SQL} select {sql_rounded('auc', DIGITS)} as "Auc"
        from {sql_auc('l_extendedprice', 'returned', '', 'items')} a""",
}
