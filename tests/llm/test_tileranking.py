"""Ranking against a plain loop over documents and items."""

import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegraph.llm import tileranking as tr

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item_id long, score string"


def terms_of(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(small)


def brute(documents, items, nearest):
    bags = [(doc_id, Counter(terms_of(text))) for doc_id, text in documents]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for item_id, text in items:
        wanted.setdefault(item_id, set()).update(terms_of(text))
    out = set()
    for item_id, want in wanted.items():
        scored = []
        for doc_id, bag in bags:
            n = sum(bag.values())
            score = 0
            for t in want & bag.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * (10 + 90 * n * n_docs // total)))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        for k, (minus, absent, doc_id) in enumerate(sorted(scored)[:nearest], 1):
            out.add((item_id, k, None if absent else doc_id, -minus))
    return out


def run(spark, documents, items, nearest=tr.NEAREST, **more):
    docs = spark.createDataFrame([(a, b, 7, "x") for a, b in documents], DOCS)
    wanted = spark.createDataFrame([(a, b, 9) for a, b in items], "item_id long, text string, doc_id long")
    return [tuple(r) for r in tr.rank(docs, wanted, nearest, **more).collect()]


def corpus():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(40)] + ["Äpfel", "naïve", "東京", "x" * 300]
    texts = [" ".join(rng.choice(words, rng.integers(1, 60))) for _ in range(120)]
    documents = [(k, t) for k, t in enumerate(texts)]
    documents += [(200 + k, texts[3]) for k in range(15)]  # ties
    documents += [(3, texts[3]), (None, texts[3]), (None, None), (500, None), (501, ""), (502, " .,- "), (503, "w1 " * 200_000)]
    items = [(k, " ".join(rng.choice(words, 12))) for k in range(70)] + [(900, texts[3]), (900, "w39 W1"), (None, "W2, w2"), (901, None), (902, "nowhere")]
    return documents, items


def test_equals_a_plain_loop_with_ties_nulls_and_repeats(spark):
    documents, items = corpus()
    got = run(spark, documents, items)
    assert len(got) == len(set(got)) or len(got) == len({(a, b) for a, b, _, _ in got})
    assert set(got) == brute(documents, items, 10)


def test_groups_of_items_and_narrow_spans_change_nothing(spark, monkeypatch):
    documents, items = corpus()
    monkeypatch.setattr(tr, "TILE_TERMS", 7)
    assert set(run(spark, documents, items, 3, group_bytes=400)) == brute(documents, items, 3)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == []
    assert run(spark, [(1, "a")], []) == []
    assert run(spark, [(1, None), (2, "...")], [(1, "a")]) == []


def test_a_span_never_reaches_two_to_the_53():
    all_ = tr.Weighted([1], [np.arange(9_000)], np.full(9_000, 2**44), 10, 10)
    tile = tr.Tile(all_, 0)
    assert tile.span * 2**44 * 10**6 < 2**53 or tile.span == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 6), st.booleans()), max_size=40), st.integers(1, 6))
def test_best_of_keeps_ties_by_id(rows, nearest):
    scores, ids, absent = (np.array([r[k] for r in rows], (np.int64, np.int64, bool)[k]) for k in range(3))
    kept = [(-scores[k], absent[k], ids[k]) for k in tr.best_of(scores, ids, absent, nearest)]
    assert kept == sorted((-s, a, i) for s, i, a in rows if s > 0)[:nearest]
