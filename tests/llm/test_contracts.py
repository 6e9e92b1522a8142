"""The registered queries against their SQL, or against a plain version where SQL cannot express them."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from dqimpact.llm import lm_score, mixing, registry
from dqimpact.llm.hashed import mixed
from tests import compare


@pytest.fixture(scope="module")
def connection(folder):
    return compare.connect(folder)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_rows_match_sql(spark, folder, connection, name):
    df = registry.QUERIES[name](spark, folder)
    assert df.columns == list(compare.types_of_duckdb(connection, registry.ORACLE[name]))
    assert compare.rows_of_spark(df) == compare.rows_of_duckdb(connection, registry.ORACLE[name])


def _documents(connection):
    return connection.execute("select doc_id, coalesce(text, '') from documents order by doc_id").fetchall()


def test_token_files(spark, folder, connection):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected, start = [], 0
    for doc, text in _documents(connection):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        expected.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = registry.QUERIES["op5_token_files"](spark, folder).collect()
    assert sorted(map(tuple, found)) == expected


def test_mixing_meets_its_targets_and_repeats_its_own_arithmetic(spark, folder):
    rows = registry.QUERIES["op3_mixing"](spark, folder).toPandas()
    p = rows[["p_clean", "p_junk", "p_toxic"]].to_numpy()
    tokens, rate = rows.n_tokens.to_numpy(float), rows.rate.to_numpy()
    assert np.allclose(p.sum(axis=1), 1) and (rate >= 0).all()
    wanted = tokens.sum() * np.array([mixing.TARGETS[d] for d in ("clean", "junk", "toxic")])
    assert np.allclose((rate * tokens) @ p, wanted, rtol=1e-6)
    gram = (p * tokens[:, None]).T @ p
    plain = np.ones(len(rows))
    for _ in range(30):
        residual = (plain * tokens) @ p - wanted
        if np.abs(residual).max() < 1e-9 * tokens.sum():
            break
        plain = np.maximum(0, plain - p @ np.linalg.solve(gram, residual))
    assert np.allclose(plain, rate, atol=1e-6)


def test_classifier_table_against_plain_python(spark):
    docs = spark.createDataFrame([(1, "a b b c"), (2, "x y"), (3, "a x"), (4, "")], "doc_id long, text string")
    labelled = spark.createDataFrame([(1, "clean"), (2, "junk")], "doc_id long, domain string")
    domains = ["clean", "junk"]
    model = mixing.fit(docs, labelled, domains, buckets=64)
    got = {r["doc_id"]: r for r in mixing.with_posteriors(docs, model, domains).collect()}

    words = ["a", "b", "c", "x", "y"]
    bucket = {
        w: spark.range(1).select(F.pmod(F.xxhash64(F.lit(w)), F.lit(64))).first()[0] for w in words
    }
    table = {d: Counter({k: 0.5 for k in range(64)}) for d in domains}
    table["clean"].update({bucket[w] for w in "abc"})
    table["junk"].update({bucket[w] for w in "xy"})

    def posterior(text):
        seen = {bucket[w] for w in text.split()}
        scores = [
            math.log(2 / 4) + sum(math.log(table[d][b] / sum(table[d].values())) for b in seen) / math.sqrt(max(len(seen), 1))
            for d in domains
        ]
        whole = sum(map(math.exp, scores))
        return [math.exp(s) / whole for s in scores]

    for doc, text in [(1, "a b b c"), (2, "x y"), (3, "a x"), (4, "")]:
        assert [got[doc]["p_clean"], got[doc]["p_junk"]] == pytest.approx(posterior(text))


def test_only_telling_buckets_weigh(spark):
    """A word that marks one domain weighs; words that all share, or that hardly occur, do not."""
    docs = [(i, f"the of {'idiot' if i % 4 == 0 else 'kind'} w{i}") for i in range(200)]
    domains = ["clean", "toxic"]
    labelled = spark.createDataFrame([(i, "toxic" if i % 4 == 0 else "clean") for i, _ in docs], "doc_id long, domain string")
    _, weights = mixing.fit(
        spark.createDataFrame(docs, "doc_id long, text string"), labelled, domains, surprise=5.0, least=5
    )
    marks = [spark.range(1).select(F.pmod(F.xxhash64(F.lit(w)), F.lit(mixing.BUCKETS))).first()[0] for w in ("idiot", "kind")]
    assert {b for b, w in enumerate(weights[1]) if w} == set(marks)
    assert weights[1][marks[0]] > 0 > weights[1][marks[1]]


def test_mixing_like_clean_documents_drops_toxic_ones(spark):
    docs = spark.createDataFrame(
        [(i, f"the of {'idiot' if i % 4 == 0 else 'kind'} w{i}") for i in range(400)], "doc_id long, text string"
    )
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    rows = mixing.mixing_rates(docs, labels, like="clean", classifier=mixing.TELLING).collect()
    assert all((r["rate"] < 0.01) == (r["doc_id"] % 4 == 0) for r in rows)
    assert all(r["rate"] > 1 for r in rows if r["doc_id"] % 4)
    assert rows[0]["missed"] < 1e-9


def test_mixing_ends_at_a_least_squares_solution(spark):
    """Targets that no rates meet: the gradient leaves no document to move."""
    rows = spark.createDataFrame([(100, 0.9, 0.1), (300, 0.8, 0.2)], "n_tokens long, p_clean double, p_toxic double")
    with pytest.warns(UserWarning, match="missed"):
        got = mixing.with_rates(rows, {"clean": 1.0, "toxic": 0.0}).toPandas()
    p, t, r = got[["p_clean", "p_toxic"]].to_numpy(), got.n_tokens.to_numpy(float), got.rate.to_numpy()
    slope = p @ np.linalg.solve((p * t[:, None]).T @ p + 0.004 * np.eye(2), (r * t) @ p - np.array([400.0, 0.0]))
    assert np.allclose(np.where(r > 0, slope, np.minimum(slope, 0)), 0, atol=1e-6)


def test_language_models_against_plain_counts(spark, folder, connection):
    smoothing = lm_score.Smoothing()
    texts = dict(_documents(connection))
    good = {d for (d,) in connection.execute("select doc_id from labels where quality = 1 and toxic = 0").fetchall()}
    counts = Counter(w for t in texts.values() for w in t.encode().split())
    total = sum(counts.values())
    words = {w: i + 3 for i, w in enumerate(sorted(w for w, n in counts.items() if n * lm_score.WORDS >= total))}

    def numbers(text):
        return [1, *(words.get(w, 0) for w in text.encode().split()), 2]

    def bucket(v, w):
        return int(mixed(np.array([(v << 20) | w], np.uint64))[0] >> np.uint64(64 - lm_score.BIGRAM_BITS))

    def model(ids):
        single, pair = Counter(), Counter()
        for d in ids:
            line = numbers(texts[d])
            single.update(line)
            pair.update(bucket(v, w) for v, w in zip(line, line[1:]))
        return single, pair, sum(n for k, n in single.items() if k != 1) + smoothing.added * (len(words) + 2)

    def loss(text, m):
        single, pair, whole = m
        line = numbers(text)
        each = [
            -math.log(
                (pair[bucket(v, w)] + smoothing.backoff * (single[w] + smoothing.added) / whole)
                / (single[v] + smoothing.backoff)
            )
            for v, w in zip(line, line[1:])
        ]
        return sum(each) / len(each)

    near, far = model(good & set(texts)), model(texts)
    for row in registry.QUERIES["op6_lm_score"](spark, folder).filter("doc_id % 20 = 0").collect():
        text = texts[row["doc_id"]]
        assert row["target_loss"] == pytest.approx(loss(text, near), abs=1e-6)
        assert row["background_loss"] == pytest.approx(loss(text, far), abs=1e-6)
        assert row["score"] == pytest.approx(row["target_loss"] - row["background_loss"])


def test_quality_model_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    scored = registry.QUERIES["op9_quality_model"](spark, folder).join(
        spark.read.parquet(f"{folder}/labels.parquet"), "doc_id"
    )
    rows = scored.filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)


def test_pipeline_stages_against_plain_versions(spark, folder, connection):
    """Each stage on what the one before it kept."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, folder).cache()
        kept[name] = (before, docs)
        if name != "token files":
            assert docs.columns == columns

    before, after = kept["quality rules"]
    told = {r[0]: r[1] for r in connection.execute(f"select doc_id, kept from ({registry.ORACLE['op1_quality_rules']})").fetchall()}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(d for d, ok in told.items() if ok)

    before, after = kept["n-gram Jaccard join"]
    sets = {}
    for r in before.collect():
        words = r["text"].encode().lower().split()
        sets[r["doc_id"]] = {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert sorted(r["doc_id"] for r in after.collect()) == [d for d in ids if find(d) == d]

    before, after = kept["benchmark decontamination"]
    dirty = {d for (d,) in connection.execute(f"select doc_id from ({registry.ORACLE['op7_decontamination']}) where contaminated").fetchall()}
    lines_kept = {r["doc_id"] for r in before.collect()}
    clean_kept = {r["doc_id"] for r in after.collect()}
    assert clean_kept <= lines_kept and lines_kept - clean_kept <= dirty

    before, after = kept["mixing to target weights"]
    rated = {r["doc_id"]: r["rate"] for r in mixing.mixing_rates(before, spark.read.parquet(f"{folder}/labels.parquet"), like="clean", classifier=mixing.TELLING).collect()}
    times = Counter(r["doc_id"] for r in after.collect())
    assert set(times) <= set(rated)
    assert all(math.floor(rate) <= times[d] <= math.floor(rate) + 1 for d, rate in rated.items())

    before, after = kept["token files"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = sorted((r["doc_id"], len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1) for r in before.collect())
    assert sorted((r["doc_id"], r["n_tokens"]) for r in after.collect()) == sizes


def test_digest_of_an_empty_item_list(spark, folder):
    rows = registry.QUERIES["op7_decontamination"](spark, folder).filter("n_items = 0").limit(1).collect()
    assert rows[0]["items_sha256"] == hashlib.sha256(b"").hexdigest()
