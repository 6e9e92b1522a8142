"""Clashing column names, very long texts, broken promises of templates, tokenizers of other kinds, odd rows in stages."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from dqimpact.llm import chat_format, decontaminate, url_filter, warc
from dqimpact.llm.quality_rules import quality_rules
from dqimpact.llm.store import shared_folder
from dqimpact.llm.token_files import word_encoder, words_end_at_space

PROSE = "The quick brown fox jumps over the lazy dog and then runs far away into the dark wood beyond the old stone wall."
WORDS = len(PROSE.split())
CLASHES = ["_text", "_words", "_lines", "_odd", "KEPT", "N_words", "a.b", "own0", "Own1", "Host", "Rule", "MATCHES", "back`tick"]
LEFT_OUT = {"KEPT", "N_words"}


@pytest.fixture(scope="module")
def clashing(spark):
    rows = spark.createDataFrame([(1, PROSE), (2, None), (3, "")], "doc_id long, text string")
    return rows.select("*", *[F.lit(c).alias(c) for c in CLASHES])


def test_quality_rules_names(clashing):
    out = quality_rules(clashing)
    assert out.columns[:2] == ["doc_id", "text"]
    assert [c for c in out.columns if c in CLASHES] == [c for c in CLASHES if c not in LEFT_OUT]
    for row in out.collect():
        assert all(row[c] == c for c in CLASHES if c not in LEFT_OUT)
        assert row["n_words"] == (WORDS if row["doc_id"] == 1 else 0) and row["kept"] == (row["doc_id"] == 1)


def test_passages_names(spark, clashing):
    benchmark = spark.createDataFrame([("i", PROSE)], "item_id string, text string")
    found = decontaminate.contamination(decontaminate.find_passages(clashing, benchmark))
    assert {c for c in CLASHES if c not in found.columns} == {"N_words", "MATCHES"}
    assert {r["doc_id"]: r["n_hit"] for r in found.collect()} == {1: WORDS, 2: 0, 3: 0}
    assert {r["a.b"] for r in found.collect()} == {"a.b"}
    clean = decontaminate.decontaminated(clashing, benchmark)
    assert clean.columns == clashing.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == [2, 3]


def test_urls_names_and_long_urls(spark):
    long = "http://a.example.org/en/1" + "x" * 300_000
    rows = spark.createDataFrame([(1, long), (2, None)], "page_id long, url string").select(
        "*", *[F.lit(c).alias(c) for c in CLASHES]
    )
    rules = spark.createDataFrame([("example.org", "/en/1", "block")], "host string, path string, verdict string")
    out = url_filter.judge_urls(rows, rules)
    assert {c for c in CLASHES if c not in out.columns} == {"Host", "Rule"}
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in out.collect()} == {
        1: ("example.org/en/1", "block"), 2: (None, "allow"),
    }


def _counting(turns):
    return "".join(f"[{i}]{role}:{text}\n" for i, (role, text) in enumerate(turns))


def test_broken_reach_is_told(spark):
    rows = [(1, t, "user", f"turn {t}") for t in range(80)]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="ReachError"):
        chat_format.format_conversations(talk, chat_format.Template(_counting, reach=0)).collect()
    whole = chat_format.format_conversations(talk, chat_format.Template(_counting, reach=None)).orderBy("block", "place")
    assert "".join(r["span"] for r in whole.collect()) == _counting([(r[2], r[3]) for r in rows])


def test_very_long_turns_and_pages(spark):
    long = "<|im_end|>\\ é" * 50_000
    talk = spark.createDataFrame([(1, 0, "assistant", long)], "conv_id long, turn long, role string, text string")
    digest = chat_format.conversation_digests(chat_format.format_conversations(talk)).first()
    assert digest["n_turns"] == 1 and digest["loss_chars"] == len(long)
    pages = spark.createDataFrame([(2, "u://a", long), (1, "u://b", long), (3, "u://c", None)], "page_id long, url string, html string")
    path = shared_folder(spark, "archive")
    warc.write_archive(pages, path)
    records = warc.read_archive(spark, path)
    facts = {r["page_id"]: r for r in warc.record_facts(records).collect()}
    assert [facts[i]["record_type"] for i in (1, 2, 3)] == ["response", "revisit", "response"]
    assert facts[2]["refers_to"] == 1 and facts[2]["payload_bytes"] == len(long.encode())
    profiles = {r[0]: r[1] for r in records.select("page_id", warc.header_value(F.col("header"), "WARC-Profile")).collect()}
    assert profiles == {1: None, 2: warc.SAME_PAYLOAD, 3: None}


@pytest.mark.parametrize("name, by_words", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_only_known_tokenizers_go_word_by_word(name, by_words):
    path = public_tokenizers.path(name)
    assert words_end_at_space(path) == by_words
    texts = ["", "Two  spaces, it's 42 o'clock\n\tand é.", "<|endoftext|> tail ", " lead"]
    plain = tokenizers.Tokenizer.from_file(path)
    for found, text in zip(word_encoder(path)(texts), texts, strict=True):
        assert np.array_equal(found, plain.encode(text, add_special_tokens=False).ids)


ODD = [(None, PROSE), (1, None), (2, ""), (3, PROSE), (3, PROSE), (4, " ".join(f"w{i}" for i in range(60_000)))]


def test_every_stage_takes_odd_rows(spark, folder):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("N_Words", F.lit("more"))
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, folder)
        assert out.columns == corpus_pipeline.COLUMNS
    assert corpus_pipeline.deduplicate(spark, docs, folder).count() == len(ODD)
    assert corpus_pipeline.decontaminate(spark, docs, folder).count() == len(ODD)
    assert corpus_pipeline.tokenize(spark, docs, folder).count() == len(ODD)
