"""The audit against dense arithmetic in whole numbers."""

import re
from collections import Counter, defaultdict

import numpy as np

from tidegraph.llm import divergence as dv
from tidegraph.llm import terms as tm

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least):
    docs = defaultdict(list)
    for text, lang, source in rows:
        small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        docs[lang or ""].append((source or "", Counter(TERM.findall(small))))
    out = set()
    for lang, held in docs.items():
        df = Counter(t for _, bag in held for t in bag)
        kept = sorted(t for t in df if df[t] >= least)
        sums = {s: Counter() for s, _ in held}
        for s, bag in held:
            sums[s].update({t: n for t, n in bag.items() if df[t] >= least})
        every = sum(sums.values(), Counter())

        def shares(counts, kept=kept):
            n = sum(counts.values())
            return {t: 1 + 10**9 * (counts[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in sums.items()}, shares(every)
        for s in sums:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sums if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if sums[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {
                    (lang, s, part, item, value, k)
                    for k, (value, item) in enumerate(ranked[: None if part == "pair" else 50], 1)
                }
    return out


def corpus():
    rng = np.random.default_rng(11)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90)] + ["Ärger", "東京", "z" * 400]
    rows = []
    for k in range(400):
        source = f"s{min(k % 11, 7)}" if k % 3 else "hot"
        skew = rng.permutation(len(words))[: 20 + k % 30]
        rows.append((" ".join(rng.choice(np.array(words)[skew], rng.integers(0, 60))), ["en", "de", None][k % 3 if k % 2 else 0], source))
    rows += [(None, "en", "nothing"), ("", "en", None), ("123 ...", "xx", "a"), ("once", "xx", "b"), ("w1a " * 50_000, "en", "long")]
    return rows + rows[:20]


def run(spark, rows, least, **more):
    docs = spark.createDataFrame(
        [(*r, "x", 5) for r in rows], "text string, lang string, source string, term string, index long"
    )
    got = [tuple(r) for r in dv.audit(docs, least, **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_equals_dense_arithmetic(spark):
    rows = corpus()
    assert run(spark, rows, 5) == brute(rows, 5)


def test_small_blocks_of_terms_and_sources_change_nothing(spark, monkeypatch):
    rows = corpus()
    for name, size in (("SOURCE_BLOCK", 3), ("TERM_BUCKET", 16), ("HELD_TERMS", 10), ("HELD_ENTRIES", 50)):
        monkeypatch.setattr(dv, name, size)
    assert run(spark, rows, 5, block_bytes=5_000) == brute(rows, 5)


def test_nothing_kept_and_empty_tables(spark):
    rows = [("a b", "en", "x"), ("a", "en", "y"), ("a", "en", None), (None, None, None)]
    assert run(spark, rows, 30) == brute(rows, 30)
    assert {r[4] for r in run(spark, rows, 30)} == {0}
    assert run(spark, [], 30) == set()


def test_vectors_hold_every_kept_term_of_a_document(spark):
    rows = [(" ".join(["aa"] * k + ["bb"] * 2 + ["rare" + chr(97 + k)]), "en", "s") for k in range(1, 9)]
    docs = dv.grouped(spark.createDataFrame(rows, "text string, lang string, source string"))
    words = dv.vocabulary(docs, 3).orderBy("index").collect()
    assert [(r["index"], bytes(r.term), r.df) for r in words] == [(1, b"aa", 8), (2, b"bb", 8)]
    got = sorted((tuple(r.indices), tuple(r["counts"])) for r in dv.vectors(docs, words).collect())
    assert got == sorted(((1, 2), (k, 2)) for k in range(1, 9))


def test_vectors_are_summed_where_they_are_made(spark, capsys):
    docs = dv.grouped(spark.createDataFrame([("aa bb", "en", "s"), ("bb", "en", "s")], "text string, lang string, source string"))
    sums = dv.vector_sums(docs, dv.vocabulary(docs, 1).collect())
    capsys.readouterr()
    sums.explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
    assert sorted(tuple(r) for r in sums.collect()) == [("en", "s", 1, 2), ("en", "s", 2, 1)]


def test_vectors_of_many_texts_equal_their_bags():
    texts = [b"", b"  ", b"A b\xff\xfe a", b"12 3", b"\x1c\x85 q \x00Q", b"x y " * 1_200_000, b"z" * 5_000_000, "Ärger ärger".encode()]
    found = [Counter() for _ in texts]
    for terms, *entries in tm.vectors(texts, tm.LETTERS, lambda terms: np.arange(len(terms))):
        named = terms.to_pylist()
        for text, index, count in zip(*(x.tolist() for x in entries), strict=True):
            found[text][named[index]] += count
    assert found == [tm.bag(x, tm.LETTERS) for x in texts]
