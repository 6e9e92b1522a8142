"""Reading and writing of files, on small tables."""

from __future__ import annotations

from dqimpact.operators.correlate import quantile_edges
from dqimpact.sources import tables


def test_preview_and_header(spark, tmp_path):
    path = str(tmp_path / "words.csv")
    rows = spark.createDataFrame([(i, "größe") for i in range(40)], "n int, `wörter` string").coalesce(1)
    rows.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    assert tables.read_columns(spark, path, "ISO-8859-1") == ["n", "wörter"]
    found = tables.preview(spark, path).collect()
    assert [r["n"] for r in found] == [str(i) for i in range(15)] and {r["wörter"] for r in found} == {"größe"}


def test_parquet_and_orc_datasets(spark, tmp_path):
    given = spark.range(5).withColumnRenamed("id", "a")
    given.write.parquet(str(tmp_path / "t.parquet"))
    given.write.orc(str(tmp_path / "t.orc"))
    for name in ("t.parquet", "t.orc"):
        assert tables.read_columns(spark, str(tmp_path / name)) == ["a"]
        assert sorted(r["a"] for r in tables.read_table(spark, str(tmp_path / name)).collect()) == list(range(5))


def test_correlations_are_left_out_unopened(spark, tmp_path):
    values = ("d", "NULL", 0.0, "NULL", "GaussianNB", 0.5, None, 0.5, 0.5, 0.5)
    result = spark.createDataFrame([values], tables.EXPERIMENTS)
    tables.export_experiments(result, str(tmp_path / "experiments-d.csv"))
    tables.append_csv(spark.createDataFrame([("x", 0.5)], "Feature string, Correlation double"), str(tmp_path / "correlation_results.csv"))
    read = tables.read_experiments(spark, f"{tmp_path}/*")
    assert [tuple(r)[:10] for r in read.collect()] == [values]
    assert [r["name"] for r in tables.loaded_files(read).collect()] == ["experiments_d"]


def test_quantile_edges(spark):
    rows = [(float(x), None) for x in (1, 2, 2, 2, 2, 3, 4, 5)] + [(None, None)]
    df = spark.createDataFrame(rows, "a double, b double")
    # Below 1, 2, 3, 4, 5 lie 0, 1, 5, 6, 7 of 8 rows: bins 0, 0, 2, 3, 3 of four.
    assert quantile_edges(df, ["a", "b"], 4) == {"a": [3.0, 4.0], "b": []}
