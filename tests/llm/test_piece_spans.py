"""Pieces and their spans against the library itself, for several kinds of models."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from dqimpact.llm import piece_spans, registry

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LONG = "Ein langes Wort " * 8_000 + "x" * 50_000
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "a b"), (4, "a b"), (None, "▁ no id ①"), (5, LONG)]
SIGNS = [*"aAbe  \n\t\r　.,ﬁ①㌔ÅÀé▁▁¨´​­\u0001\u0007漢字한국ᄀ각\U0001f600éñß<s>  ﷺ", "<sep>", "  ", "\0"]


def variant(folder, rule=None, user=(), bytewise=True, at_end=False, **spec) -> str:
    """The model file with another normaliser; its vocabulary stays."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as file:
        model.ParseFromString(file.read())
    if rule:
        model.normalizer_spec.ParseFromString(
            sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec()
        )
    for name, value in spec.items():
        setattr(model.normalizer_spec, name, value)
    for piece in user:
        model.pieces.add(piece=piece, type=4, score=0)
    model.trainer_spec.treat_whitespace_as_suffix = at_end
    if not bytewise:
        model.trainer_spec.byte_fallback = False
        for piece in model.pieces:
            piece.type = 5 if piece.type == 6 else piece.type
    path = folder / f"{len(list(folder.iterdir()))}.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


def expected(encoder, text: str) -> list[tuple[int, int, int]]:
    return [(p.id, p.begin, p.end) for p in encoder.original.encode(text, return_type="proto").pieces]


def found(encoder, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    return [list(zip(*(x.tolist() for x in row), strict=True)) for row in encoder(texts)]


@pytest.mark.parametrize(
    "changes",
    [
        {},
        {"rule": "nmt_nfkc"},
        {"rule": "nfkc_cf", "remove_extra_whitespaces": False},
        {"rule": "nmt_nfkc", "add_dummy_prefix": False},
        {"rule": "nmt_nfkc", "bytewise": False},
        {"rule": "nmt_nfkc", "at_end": True},
        {"rule": "nmt_nfkc", "user": ("<sep>", "a  b")},
        {"rule": "nmt_nfkc", "escape_whitespaces": False},
    ],
    ids=str,
)
def test_pieces_and_spans_are_those_of_the_library(tmp_path, changes):
    encoder = piece_spans.SpanEncoder(variant(tmp_path, **changes))
    draw = random.Random(7)
    texts = ["".join(draw.choices(SIGNS, k=draw.randint(0, 25))) for _ in range(1_500)]
    assert found(encoder, texts) == [expected(encoder, t) for t in texts]


@pytest.fixture(scope="module")
def mapped(tmp_path_factory):
    return piece_spans.SpanEncoder(variant(tmp_path_factory.mktemp("models"), rule="nmt_nfkc"))


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_any_text(mapped, text):
    assert found(mapped, [text]) == [expected(mapped, text)]


def test_memory_is_bounded_without_a_change_of_results(mapped, monkeypatch):
    monkeypatch.setattr(piece_spans, "REMEMBERED", 3)
    fresh = piece_spans.SpanEncoder(MODEL)
    texts = [f"word{i} and more of them" for i in range(50)]
    assert found(fresh, texts) == [expected(fresh, t) for t in texts]
    assert len(fresh.known) == 3


def test_query_on_whole_documents(spark, folder):
    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    wanted = {}
    for doc, text in docs:
        ids = processor.encode(text or "", add_bos=True, add_eos=True)
        packed, decoded = np.array(ids, "<u4").tobytes(), processor.decode(ids).encode()
        wanted[doc] = len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest()
    rows = registry.QUERIES["op11_piece_spans"](spark, folder).collect()
    assert len(rows) == len(docs)
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows} == wanted


def test_odd_rows(spark):
    schema = "doc_id long, text string, ids string, begins string, `a.b` int"
    rows = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in ODD], schema)
    encoded = piece_spans.encode_spans(rows, MODEL)
    got = encoded.collect()
    assert len(got) == len(ODD)
    assert [r["ids"] for r in got if r["doc_id"] in (1, 2)] == [[1, 2], [1, 2]]
    assert [r["ids"] for r in got if r["doc_id"] == 4] == [[1, 264, 287, 2]] * 2
    for row in got:
        text = dict(ODD)[row["doc_id"]] or ""
        data = text.encode()
        assert row["n_bytes"] == len(data) == row["ends"][-1]
        # This model changes no character, so its spans lie side by side and cover the text.
        spans = zip(row["begins"][1:-1], row["ends"][1:-1], strict=True)
        assert b"".join(data[a:b] for a, b in spans) == data
    digests = piece_spans.decode_digests(encoded, MODEL).collect()
    assert {r["span_bytes"] for r in digests if r["doc_id"] == 5} == {len(LONG)}
    bare = piece_spans.encode_spans(rows.filter("doc_id = 2"), MODEL, marks=False)
    assert bare.first()["ids"] == []
    assert piece_spans.decode_digests(bare, MODEL).first()["n_tokens"] == 0
    assert piece_spans.decode_digests(piece_spans.encode_spans(rows.filter("false"), MODEL), MODEL).count() == 0
