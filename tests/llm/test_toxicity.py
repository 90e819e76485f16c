import random
import zlib

import numpy as np

from tidegraph.llm.toxicity import (
    MARKS,
    Lexicon,
    best_path,
    evidence,
    grammar,
    insult_weight,
    learn,
    learn_lexicon,
    score,
    without_toxic,
)

SF = "/root/testdata/sf0.1"


def test_held_out_rows_are_told_apart(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = score(documents, learn(documents, labels))
    rows = scored.join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    assert len(rows) > 500 and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    toxic = [r.predicted == 1 for r in rows if r.toxic == 1]
    clean = [r.predicted == 0 for r in rows if r.toxic == 0]
    assert np.mean(toxic) > 0.9 and np.mean(clean) > 0.985
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


LEXICON = Lexicon({"fool": 2.0})


def marked(text):
    found = evidence(text, LEXICON)
    return {} if found is None else {m: round(float(np.expm1(v)), 6) for m, v in zip(MARKS, found, strict=False) if v}


def test_clauses_are_read_by_the_grammar():
    assert marked("a fool") == {"i": 2.0}
    assert marked("you fool") == {"iy": 2.5} and marked("what a fool he is") == {"iy": 2.5}
    assert marked("not a fool") == {"in": 1.0}
    assert marked("kim said a fool") == {"ir": 1.0}
    assert marked("kim said not a big fool") == {} and marked("kim wrote you no real fool") == {"inr": 0.5}
    assert marked("she said it. a fool") == {"i": 2.0}
    assert marked("not one two three four fool") == {"i": 2.0}
    assert marked("i will hurt you") == {"ty": 2.0} and marked("you hurt") == {"ty": 1.5}
    assert marked("Foolish words") == {} and marked("") == {}
    assert insult_weight("foolish", {"fool*": 1.5}) == 1.5 and insult_weight("fool", {"fool*": 1.5}) is None
    assert evidence("a fool. the fool! none. fool so", Lexicon({"fool": 1.0}))[-1] == 3


def test_a_word_alone_or_a_threat_to_nobody_does_not_match():
    assert marked("fool") == {} and marked("fool. fool! fool") == {}
    assert marked("hurt feelings") == {} and marked("one will beat the egg") == {}
    assert marked("you one two three four hurt") == {}


def every_path(machines, clause):
    """(weight, matches) of all paths: each machine reads whole tapes written by the one before."""
    tapes = [(0.0, list(clause))]
    for machine in machines:
        written = []
        for weight, tape in tapes:
            paths = [(machine.start, weight, [])]
            for x in tape:
                paths = [(after, w + v, [*out, y]) for state, w, out in paths for after, y, v in machine.arcs(state, x)]
            written += [(w, out) for state, w, out in paths if machine.final(state)]
        tapes = written
    return [(w, [x.match for x in tape if x.match]) for w, tape in tapes]


def test_the_best_path_equals_brute_force():
    random.seed(5)
    words = ["fool", "kill", "you", "not", "said", "will", "plain", "him"]
    for _ in range(400):
        clause = [LEXICON.symbol(random.choice(words)) for _ in range(random.randint(1, 6))]
        weight, matches = best_path(LEXICON.machine, clause)
        paths = every_path(grammar(LEXICON.negation), clause)
        assert weight == max(w for w, _ in paths) and (weight, matches) in paths


def test_labels_weigh_the_seed_words(spark):
    rows = [(f"we will kill one {k}", 1) for k in range(30)] + [(f"they die like flies {k}", 0) for k in range(300)]
    rows += [(f"kim said so {k}", 0) for k in range(30)]
    lexicon = learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert lexicon.threats["kill"] > lexicon.threats["stab"] == 1.0 > lexicon.threats["die"] == 0.0
    assert lexicon.reports["said"] > lexicon.reports["wrote"] == 1.0


def test_edge_cases(spark):
    rows = [(k, f"you rotten thing {k}" if k % 3 == 0 else f"a fine thing {k}", "c") for k in range(1, 400)]
    rows += [(500, None, "c"), (501, "", "c"), (502, "rotten " * 50_000, "c"), (503, "she is rotten", "c"), (503, "she is rotten", "c"), (None, "she is rotten", "c"), (504, "rotten", "c")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, score string")
    given = [(k, int(k % 3 == 0)) for k in range(1, 400)] + [(None, 1), (500, None), (3, 0), (9999, 1)]
    labels = spark.createDataFrame(given, "doc_id long, toxic int")
    model = learn(documents, labels)
    assert set(model.lexicon.insults) >= {"rotten"} and "thing" not in model.lexicon.insults
    got = score(documents, model).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and not by_id[None].held_out
    assert by_id[500].predicted == by_id[501].predicted == by_id[504].predicted == by_id[1].predicted == 0
    assert by_id[502].predicted == by_id[503].predicted == by_id[None].predicted == by_id[6].predicted == 1
    kept = [r.doc_id for r in without_toxic(documents, model).collect()]
    assert sorted(kept) == sorted([k for k in range(1, 400) if k % 3] + [500, 501, 504])
    empty = documents.limit(0)
    assert score(empty, learn(empty, labels.limit(0))).count() == 0
    assert {r.predicted for r in score(documents, learn(empty, labels)).collect()} == {0}
