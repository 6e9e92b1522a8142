"""Odd rows, planted cases and empty tables for each operator."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from dqimpact.llm import chat_format, components, decontaminate, lm_score, mixing, ngram_join, quality_model, url_filter, warc
from dqimpact.llm.quality_rules import quality_rules
from dqimpact.llm.store import shared_folder
from dqimpact.llm.token_files import checksums, read_token_files, write_token_files

DOCS = "doc_id long, text string, kept string, n_words string, hit_starts string, key string, node string"
LONG = " ".join(f"w{i % 5000}" for i in range(60_000))
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "Only four words here."), (4, "Only four words here."), (None, "no id at all"),
    (5, LONG), (6, LONG), (7, "\n".join(["Same line again."] * 9)),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", "y", "z", "k", "n") for i, t in ODD], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 1), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")


def test_quality_rules(odd, empty):
    rows = {(r["doc_id"], r["text"]): r for r in quality_rules(odd).collect()}
    assert quality_rules(odd).count() == len(ODD)
    for text in (None, "", " \n\t "):
        row = next(r for (_, t), r in rows.items() if t == text)
        assert (row["n_words"], row["word_chars"], row["n_repeat_words"], row["base_failed"], row["kept"]) == (0, 0, 0, True, False)
    assert rows[7, ODD[8][1]]["n_dup_lines"] == 8
    assert rows[5, LONG]["n_repeat_words"] == 60_000 and rows[5, LONG]["base_failed"]
    assert rows[5, LONG]["key"] == "k"
    assert quality_rules(empty).count() == 0


def test_line_rules(spark):
    prose = "The quick brown fox jumps over the lazy dog and runs far away into the dark wood."
    other = "Nobody in this small village had ever seen such a beast, or would have believed a word of it."
    lines = [prose, "Home | About | News | Contact | Shop | More", "All rights reserved.", "with%%% marks&&& on### words***", "cut off in the"]
    row = quality_rules(spark.createDataFrame([(1, "\n".join([*lines, other]))], "doc_id long, text string")).first()
    assert row["cleaned_text"] == f"{prose}\n{other}"
    assert row["n_removed_lines"] == 4 and row["kept"]


def test_ngram_components(spark, odd, empty):
    rows = ngram_join.ngram_components(odd).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert [by[k]["component_id"] for k in (1, 2, 3, 4, 5, 6, 7, None)] == [1, 2, 3, 4, 5, 5, 7, None]
    assert [by[k]["n_shingles"] for k in (1, 2, 3)] == [0, 0, 0]
    assert ngram_join.ngram_components(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_components_of_random_families(spark, seed):
    """Families of edited copies around the threshold, against all pairs."""
    rng = np.random.default_rng(seed)
    texts = []
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(int(rng.integers(20, 120)))]
        for _ in range(25):
            words = list(base)
            for _ in range(int(rng.integers(0, 5))):
                at, kind = int(rng.integers(len(words))), int(rng.integers(3))
                words[at : at + (kind < 2)] = [] if kind == 0 else [f"e{rng.integers(30)}"]
            texts.append(" ".join(words))
    texts += [" ".join(f"f0w{i}" for i in range(30)) + f" x{k} y{k} z{k}" for k in range(10)]
    rows = list(enumerate(texts))
    sets = [{tuple(t.split()[i : i + 4]) for i in range(max(len(t.split()) - 3, 1))} for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 100 * common >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: find(i) for i in range(len(texts))}
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in enumerate(sets)}


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(200, 100), (100, 200)], "a long, b long")
    found = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 200: 100}
    assert components.components(links.limit(0)).count() == 0


def test_chat_format(spark):
    rows = [
        (1, 0, None, None), (1, 1, "assistant", "a\\|b <|im_end|> \\"), (1, 1, "assistant", "a\\|b <|im_end|> \\"),
        (1, 2, "us<|er\nx", ""), (None, None, "assistant", "ok"),
    ]
    talks = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, block string")
    formatted = chat_format.format_conversations(talks)
    assert not formatted.filter("rewrites").count()
    found = {r["conv_id"]: r for r in chat_format.conversation_digests(formatted).collect()}
    told = "".join(f"{role or ''}\n{text or ''}\n" for _, _, role, text in rows[:4])
    assert found[1]["n_turns"] == 4
    assert found[1]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
    assert found[1]["loss_sha256"] == hashlib.sha256((rows[1][3] * 2).encode()).hexdigest()
    assert found[None]["loss_chars"] == 2
    assert chat_format.conversation_digests(chat_format.format_conversations(talks.limit(0))).count() == 0


def _rewriting(turns):
    """A template that drops all but the last turn's thoughts."""
    return "".join(f"[{r}]{t if i == len(turns) - 1 else t.split('//')[-1]}[end]" for i, (r, t) in enumerate(turns))


def _counting(turns):
    return "".join(f"<{i % 3}{r}>{t}</>" for i, (r, t) in enumerate(turns))


def _chained(turns):
    """The start of a turn tells how long the text before it was."""
    return "".join(f"({len(turns[i - 1][1]) if i else '-'}{r}){t};" for i, (r, t) in enumerate(turns))


@pytest.mark.parametrize("render, reach", [(_rewriting, None), (_counting, None), (_chained, 1)])
def test_other_templates(spark, render, reach):
    turns = [("user", "hm//hello"), ("assistant", "well//hi"), ("user", "bye")] * 25
    talks = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    rows = chat_format.format_conversations(talks, chat_format.Template(render, reach)).collect()
    assert len(rows) == len(turns)
    assert any(r["rewrites"] for r in rows) == (render is _rewriting)
    if render is not _rewriting:
        rows.sort(key=lambda r: (r["block"], r["place"]))
        assert "".join(r["span"] for r in rows) == render(turns)
        assert [r["span"][r["text_start"] : r["text_end"]] for r in rows] == [t for _, t in turns]


def test_mixing(spark, odd, empty, labels):
    rows = mixing.mixing_rates(odd, labels, keep=["text", "key"]).collect()
    assert len(rows) == len(ODD) and all(r["rate"] >= 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    assert mixing.mixing_rates(odd, labels.limit(0)).count() == len(ODD)
    assert mixing.mixing_rates(empty, labels).count() == 0


def test_token_files(spark, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")

    def written(docs):
        at = shared_folder(spark, "t")
        write_token_files(docs, at, path)
        return checksums(read_token_files(spark, at)).orderBy("start").collect()

    rows = written(odd.repartition(3))
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 4, 5, 6, 7]
    assert [r["n_tokens"] for r in rows[1:4]] == [1, 1, 1]
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(rows, rows[1:]))
    assert written(empty) == []


def test_lm_score(spark, odd, empty, labels):
    rows = lm_score.score_documents(odd, labels).collect()
    assert len(rows) == len(ODD) and all(np.isfinite(r["score"]) for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert len(lm_score.score_documents(odd, labels.limit(0)).collect()) == len(ODD)
    assert lm_score.score_documents(empty, labels).count() == 0


def _benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_decontamination(spark, odd, empty):
    items = [(1, None), (2, "?!"), (10, "four words HERE"), (9, "w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17"), (None, "no id at all"), (10, "four words HERE")]
    for block in (1, 1 << 20):
        judged = decontaminate.contamination(decontaminate.find_passages(odd, _benchmark(spark, items), block_bytes=block))
        rows = {r["doc_id"]: r for r in judged.collect()}
        assert judged.count() == len(ODD)
        assert [rows[k]["n_hit"] for k in (1, 2, 3, 4, 7, None)] == [0, 0, 0, 3, 0, 4]
        assert rows[5]["n_hit"] == 12 * 11 and rows[5]["item_ids"] == ["9"] and rows[4]["item_ids"] == ["10"]
        assert rows[None]["item_ids"] == [""]
        match = rows[5]["matches"][0]
        assert (match["words"], match["doc_word"], match["item_word"]) == (11, 7, 0)
    kept = decontaminate.decontaminated(odd, _benchmark(spark, items))
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 7]
    assert decontaminate.find_passages(odd, _benchmark(spark, [])).count() == len(ODD)
    assert decontaminate.find_passages(empty, _benchmark(spark, items)).count() == 0


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(5)
    for _ in range(30):
        text = rng.integers(-1, 3, 60).astype(np.int64)
        text[-1] = -1

        def suffix(i, text=text):
            end = i
            while text[end] >= 0:
                end += 1
            return text[i:end].tolist()

        array = decontaminate.suffix_array(text, 100)
        found = [suffix(i) for i in array]
        assert sorted(array.tolist()) == [i for i in range(60) if text[i] >= 0] and found == sorted(found)


def test_url_filter(spark):
    rules = spark.createDataFrame(
        [("org", "/", "allow"), ("Example.org", "/en/1", "block"), ("example.org", "/en/1", "allow"), (None, "/", "block"), ("b.example.org", "/e", "block")],
        "host string, path string, verdict string",
    )
    urls = ["http://a.b.Example.ORG/en/1?x", "http://a.b.example.org/en/2", "https://x.org", "http://xorg/", None, "no scheme", "ftp://org/#f", "http://notexample.org/en/1"]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls * 2)], "page_id long, url string, verdict string")
    rows = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules, default="allow").collect()}
    assert len(rows) == 16
    assert rows[0] == ("a.b.example.org", "/en/1", "example.org/en/1", "block")
    assert rows[1] == ("a.b.example.org", "/en/2", "b.example.org/e", "block")
    assert rows[2] == ("x.org", "", None, "allow") and rows[3] == ("xorg", "/", None, "allow")
    assert rows[4] == rows[5] == ("", "", None, "allow")
    assert rows[6] == ("org", "/", "org/", "allow") and rows[7][2] == "org/"
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert url_filter.judge_urls(pages, rules.limit(0)).filter("rule is null").count() == 16


def test_quality_model(spark, odd, empty, labels):
    trees = quality_model.learn(odd, labels)
    rows = quality_model.score_quality(odd, trees).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    blank = quality_model.learn(odd, labels.limit(0))
    assert {r["score"] for r in quality_model.score_quality(odd, blank).collect()} == {0.5}
    assert quality_model.score_quality(empty, trees).count() == 0


def test_trees_walk_like_a_plain_tree():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(400, 5))
    labels = ((rows[:, 1] > 0.2) ^ (rows[:, 3] > 0)).astype(float)
    trees = quality_model.fit(rows, labels, quality_model.Settings(trees=20))

    def plain(row):
        margin = trees.base
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + (row[feature[node]] > threshold[node])
            margin += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-margin))

    scores = trees.scores(rows)
    assert np.allclose(scores, [plain(r) for r in rows])
    assert ((scores > 0.5) == (labels > 0)).mean() > 0.97


def test_web_archive(spark):
    rows = [(5, "http://a/\r\nb", "same"), (3, None, "same"), (3, None, "same"), (9, "u", None), (8, "u", ""), (None, "u", "same"), (None, "u", "alone")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    path = shared_folder(spark, "w")
    warc.write_archive(pages, path)
    records = warc.read_archive(spark, path)
    found = sorted(
        ((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["verified"]) for r in warc.record_facts(records).collect()),
        key=repr,
    )
    assert found == sorted(
        [(5, "revisit", 3, 4, True), (3, "response", None, 4, True), (3, "response", None, 4, True), (9, "revisit", 8, 0, True),
         (8, "response", None, 0, True), (None, "revisit", 3, 4, True), (None, "response", None, 5, True)],
        key=repr,
    )
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    held = records.filter("page_id = 5").first()
    assert b"WARC-Target-URI: http://a/%0D%0Ab\r\n" in bytes(held["header"])
    raw = records.filter("page_id = 3").select(warc.raw_record(F.col("header"), F.col("payload"), F.lit(True)).alias("r")).first()["r"]
    assert bytes(raw).endswith(b"Content-Length: 4\r\n\r\nsame\r\n\r\n")
    other = shared_folder(spark, "w")
    warc.write_archive(pages.limit(0), other)
    assert warc.read_archive(spark, other).count() == 0


def test_pipeline_on_odd_tables(spark, tmp_path):
    folder = str(tmp_path)
    rows = [(i, t, "en", None, 1) for i, t in ODD]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    _benchmark(spark, [(1, None)]).write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_lm_score_keeps_rare_words_and_all_targets(spark):
    """Neither the vocabulary nor the target shrinks with the corpus; chunks do not show."""
    import math
    from collections import Counter

    rare = [(i, f"rare{i % 300} pair{i % 300} the") for i in range(600)]
    texts = dict([*rare, *((i, "the of " * 500) for i in range(600, 800))])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 600, 2)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in lm_score.score_documents(docs, labels, chunk_words=1000).collect()}
    assert set(got) == set(texts)

    def loss(doc, ids):
        single, pair = Counter(), Counter()
        for i in ids:
            line = ["<", *texts[i].split(), ">"]
            single.update(line)
            pair.update(zip(line, line[1:]))
        whole = sum(n for w, n in single.items() if w != "<") + 0.5 * (602 + 2)
        line = ["<", *texts[doc].split(), ">"]
        each = [-math.log((pair[v, w] + 5 * (single[w] + 0.5) / whole) / (single[v] + 5)) for v, w in zip(line, line[1:])]
        return sum(each) / len(each)

    for doc in (0, 1, 17, 700):
        assert got[doc]["background_loss"] == pytest.approx(loss(doc, texts), abs=1e-9)
        assert got[doc]["target_loss"] == pytest.approx(loss(doc, range(0, 600, 2)), abs=1e-9)


def test_mixing_ends_at_its_targets_when_many_rates_are_zero(spark):
    """Mostly junk: thirty projected steps were not enough."""
    draw = np.random.default_rng(7)
    n = 2000
    kind = draw.choice(3, n, p=[0.1, 0.7, 0.2])
    p = np.array([draw.dirichlet(np.where(np.arange(3) == k, 8.0, 0.5)) for k in kind])
    tokens = draw.integers(20, 2000, n)
    rows = spark.createDataFrame(
        [(int(t), *map(float, x)) for t, x in zip(tokens, p)], "n_tokens long, p_clean double, p_junk double, p_toxic double"
    )
    got = mixing.with_rates(rows, mixing.TARGETS).toPandas()
    share = (got.rate * got.n_tokens).to_numpy() @ got[["p_clean", "p_junk", "p_toxic"]].to_numpy() / tokens.sum()
    assert (got.rate >= 0).all() and (got.rate == 0).any()
    assert np.abs(share - list(mixing.TARGETS.values())).max() < 2e-9 and got.missed.max() <= 1e-9


def test_mixing_tells_of_targets_out_of_reach(spark):
    rows = spark.createDataFrame([(10, 0.5, 0.5), (20, 0.5, 0.5)], "n_tokens long, p_clean double, p_junk double")
    with pytest.warns(UserWarning, match="missed"):
        got = mixing.with_rates(rows, {"clean": 0.9, "junk": 0.1}).collect()
    assert all(r["missed"] == pytest.approx(0.4) for r in got)


def test_lm_score_chunks_hold_frequent_words_in_few_bytes():
    rng = np.random.default_rng(2)
    drawn = rng.zipf(1.3, 60_000) % 20_000
    texts = [" ".join(f"w{i}" for i in part) for part in np.split(drawn, 30)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(30), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    (made,) = lm_score._chunked(iter([batch]), 1 << 20)
    (row,) = made.to_pylist()
    chunk = lm_score._Chunk(row)
    wanted = [xxhash.xxh3_64_intdigest(f"w{i}".encode()) for i in drawn]
    assert chunk.words[chunk.places].tolist() == wanted and chunk.times.tolist() == np.bincount(chunk.places).tolist()
    plain = zlib.compress(chunk.places.astype("<u2").tobytes(), 1)
    assert len(row["places"]) + len(row["times"]) < 0.9 * len(plain)
