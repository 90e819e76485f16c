import random
import re

import numpy as np
import pyarrow as pa

from tidegraph.llm.components import components
from tidegraph.llm.minhash import near_duplicates, signature, without_copies
from tidegraph.llm.shingles import shingle_sets


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    least = [k for k, _ in rows]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if rows[i][0] is not None and rows[j][0] is not None
        and (rows[i][0] == rows[j][0] or (sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])))
    ]
    for _ in rows:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    return sorted(((k, len(s), c) for (k, _), s, c in zip(rows, sets, least, strict=True)), key=str)


def found(spark, rows):
    table = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, kept string")
    out = near_duplicates(table).collect()
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in out)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)


def changed(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(50)}"
    return " ".join(w)


def test_components_equal_brute_force(spark):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(300)}" for _ in range(n)) for n in (90, 150, 60, 12, 400)]
    texts = [changed(rng, rng.choice(base), rng.randrange(9)) for _ in range(110)] + base + base
    texts += [None, "", " \t\n", "one", "ONE", "one two", "a b c d", "A  b\tc d", "a b c d e", "É b c d", "é b c d", "x " * 5000, "x " * 7000]
    rows = [(k * 3 % 1009, t) for k, t in enumerate(texts)] + [(None, base[0]), (6, texts[2])]
    assert found(spark, rows) == brute(rows)


def test_empty_table_and_kept_rows(spark):
    schema = "doc_id long, text string, n_chars long"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    same = "a b c d e f g h"
    rows = [(4, same, 1), (2, same, 1), (2, same, 1), (7, "other words are in this one here", 2), (None, same, 3), (9, None, 4), (8, "", 5)]
    kept = sorted(map(str, (r.doc_id for r in without_copies(spark.createDataFrame(rows, schema)).collect())))
    assert kept == ["2", "7", "8", "9", "None"]


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    for share in (0.2, 0.5, 0.9):
        both = int(2000 * 2 * share / (1 + share))
        a, b = pool[:2000], np.concatenate([pool[:both], pool[2000 : 4000 - both]]) if both >= 1000 else np.concatenate([pool[:both], rng.integers(0, 1 << 63, 2000 - both).astype(np.uint64)])
        jaccard = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((signature(a, 1000) == signature(b, 1000)).mean() - jaccard) < 0.06


def test_shingle_sets_equal_plain_python():
    texts = ["", None, "a b c d e f", "A B c D e F", "é x y\x0bz\x1cq r s t", "same same same same same same same", "x" * 100_000 + " y"]
    sets = shingle_sets(pa.chunked_array([texts]))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert (sets[2] == sets[3]).all()


def test_long_chains_fold_up(spark):
    chain = [(k, k + 1) for k in range(300)] + [(1000, 1001), (1002, 1001)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(301)} | {1000: 1000, 1001: 1000, 1002: 1000}


def test_words_built_to_collide_in_a_polynomial_are_told_apart(spark):
    """The Thue-Morse word and its complement agree modulo 2^64 under every base."""
    bits = [bin(k).count("1") % 2 for k in range(2_048)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    sets = shingle_sets(pa.chunked_array([pa.array([one, two, f"x y {one} z w", f"x y {two} z w", one])]))
    assert sets[0].tolist() == sets[4].tolist() != sets[1].tolist() and sets[2].tolist() != sets[3].tolist()
    rows = [(1, one), (2, two), (3, f"x y {one} z w"), (4, f"x y {two} z w")]
    assert found(spark, rows) == brute(rows)
