import math
import random

import pyarrow.parquet as pq
import pytest
import sentencepiece

from tidegraph.llm.sentencepieces import Encoder, Vocabulary, decode, default_model, edited, encode, log_probabilities


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load(default_model())


def every_way(vocabulary, text):
    """(score, ids) of all segmentations, by brute force."""
    if not text:
        return [(0.0, [])]
    ways = []
    for end in range(1, len(text) + 1):
        score = vocabulary.prefixes.get(text[:end])
        if score is None and end == 1:
            score = vocabulary.unknown
        if score is not None:
            ways += [(s + score, vocabulary.edge_ids(text[:end]) + ids) for s, ids in every_way(vocabulary, text[end:])]
    return ways


def test_n_best_equals_brute_force(vocabulary):
    random.seed(7)
    for _ in range(150):
        text = "".join(random.choice("abethe \n日🙂é,.") for _ in range(random.randint(0, 8)))
        lattice = "▁" + text.replace(" ", "▁") if text else ""
        ways = {tuple(ids): score for score, ids in every_way(vocabulary, lattice)}
        ids, _, ranked = Encoder(vocabulary, 4).encode([text])
        best = sorted(ways.values(), reverse=True)[:4]
        assert [score for score, _ in ranked[0]] == best
        found = [tuple(edited(ids.tolist(), edits)) for _, edits in ranked[0]]
        assert len(set(found)) == len(found)
        assert [ways[f] for f in found] == best


def test_a_star_and_batched_solver_agree_with_the_plain_one(vocabulary):
    parts = ["▁the", "▁bereave", "日本語", "é", "▁" * 7, "\n", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 200, "🙂🙂"]
    for part, (ids, score, gap) in zip(parts, vocabulary.solve_all(parts), strict=True):
        assert (ids, score, gap) == vocabulary.solve(part)
        ways = vocabulary.n_best(part, 2)
        assert ways[0] == (score, ids)
        assert (ways[1][0] == score - gap) if len(ways) > 1 else gap == float("inf")


def test_scores_are_log_probabilities(vocabulary):
    total = sum(math.exp(vocabulary.scores[i]) for i in vocabulary.ids.values())
    assert abs(total - 1) < 1e-3
    assert log_probabilities([0.0, -1.0, -7.0], [True, True, False])[2] == -7.0
    ranked = log_probabilities([0.0, -1.0, -2.0], [True] * 3)
    assert ranked == sorted(ranked, reverse=True) and abs(sum(map(math.exp, ranked)) - 1) < 1e-5
    assert log_probabilities([-1.5, -2.25], [True] * 2) == [-1.5, -2.25]


def test_pieces_per_text_are_near_those_of_the_library(vocabulary):
    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    texts = [t for t in rows if t]
    ids, _, ranked = Encoder(vocabulary, 4).encode(texts)
    assert len(ids) <= 1.02 * sum(map(len, library.encode(texts)))
    assert all([s for s, _ in r] == sorted((s for s, _ in r), reverse=True) for r in ranked)


def test_round_trip_and_edge_cases(spark, vocabulary):
    texts = [None, "", " ", "  two  spaces ", "tab\tand\nline\r\n", "日本語 🙂 é", "word " * 30_000, "same", "same"]
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    encoded = encode(rows, vocabulary).cache()
    got = {r.doc_id: r for r in encoded.collect()}
    assert len(got) == len(texts) and all(r.round_trip for r in got.values())
    assert got[0].n_pieces == 0 and got[0].nbest_scores == [0.0] and got[1].ids == []
    assert got[7].ids == got[8].ids and got[7].nbest_edits == got[8].nbest_edits
    back = {r.doc_id: r.text for r in decode(encoded, vocabulary).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert decode(nothing, vocabulary).first().text is None


def test_an_empty_table(spark, vocabulary):
    assert encode(spark.createDataFrame([], "doc_id long, text string"), vocabulary).count() == 0


def test_a_small_cache_changes_nothing(vocabulary, monkeypatch):
    texts = ["the quick brown fox", "jumps over the lazy dog", "the quick red fox"] * 3
    whole = Encoder(vocabulary, 4).encode(texts)
    monkeypatch.setattr("tidegraph.llm.sentencepieces.CACHED_CHARS", 1)
    small = Encoder(vocabulary, 4)
    parts = [small.encode([t]) for t in texts]
    assert [i for ids, _, _ in parts for i in ids.tolist()] == whole[0].tolist()
    assert [r[0] for _, _, r in parts] == whole[2]
