"""Token counts against the library's encoding of whole texts."""

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegraph.llm import tokencount as tc

TEXTS = [
    None, "", " ", "  ", " \n", "a", " a", "a ", "a  b   c    ", "The quick brown fox", "Straße naïve 東京 \u0000 \t\r\n",
    "▁", "▁▁ ▁a▁", "<s> </s> <unk> <0x0A>", "x" * 3_000, " " * 500, "👩‍👩‍👧 emoji \U00010348", "a b c", "of the" * 50,
]


@pytest.fixture(scope="module")
def proof():
    return tc.prove(tc.default_model())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tc.default_model())


def test_counts_equal_the_library(spark, proof, library):
    rows = [(k % 7 if k % 5 else None, t, 3, "x") for k, t in enumerate(TEXTS * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes long, n_tokens string")
    got = sorted(tuple(r) for r in tc.token_counts(docs, proof).fillna(-1).collect())
    n = [len(library.encode(t or "")) for _, t, *_ in rows]
    assert got == sorted(
        (-1 if k is None else k, len((t or "").encode()), m, m > 4_096) for (k, t, *_), m in zip(rows, n, strict=True)
    )
    assert tc.token_counts(docs.limit(0), proof).count() == 0


def test_every_proven_piece_is_one_token(proof, library):
    assert proof.separable and len(proof.whole) > 10_000
    assert all(len(library.encode(p[1:])) == 1 for p in proof.whole)


def test_long_texts_are_cut_between_pretokens(proof, library, monkeypatch):
    monkeypatch.setattr(tc, "PIECE_CHARS", 50)
    text = ("word " * 30 + "  " + "y" * 200 + " ▁ end\n") * 20
    assert tc.Counts(proof).of(text) == len(library.encode(text))


def test_a_full_cache_starts_anew(proof, library, monkeypatch):
    monkeypatch.setattr(tc, "CACHED", 5)
    text = " ".join(f"zq{k}xv" for k in range(40))
    assert tc.Counts(proof).of(text) == len(library.encode(text))


def test_without_a_proof_whole_texts_are_encoded(proof, library):
    plain = tc.Counts(tc.Proof(proof.model, False, frozenset()))
    assert [plain.of(t or "") for t in TEXTS] == [len(library.encode(t or "")) for t in TEXTS]


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ▁\nabtheÄ東"), st.characters(codec="utf-8")), max_size=60))
def test_any_text(text):
    if not hasattr(test_any_text, "held"):
        test_any_text.held = tc.Counts(tc.prove(tc.default_model()))
    held = test_any_text.held
    assert held.of(text) == len(held.library.encode(text))
