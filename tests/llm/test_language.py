import zlib

import numpy as np

from tidegraph.llm.language import Letters, identify, learn
from tidegraph.llm.shingles import Table

SF = "/root/testdata/sf0.1"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    rows = identify(documents, learn(documents)).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 10_000 and all(r.held_out == held_out(r.doc_id) for r in rows)
    held = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert np.mean(held) > 0.98 and all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_teach_nothing(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wrong = documents.selectExpr(
        "doc_id", "text", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 'xx' ELSE lang END AS lang"
    )
    model = learn(documents)
    assert learn(wrong).languages == model.languages
    for a, b in zip(learn(wrong).logs, model.logs, strict=True):
        assert np.array_equal(a, b)


def test_known_words_come_first_then_shorter_grams(spark):
    rows = [(k, "alpha beta gamma" if k % 2 else "delta epsilon zeta", "x" if k % 2 else "y") for k in range(1, 200)]
    model = learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    means, n = model.score(["alpha", "alphx", "qqq", "", "123", "Delta ZETA"])
    assert n.tolist() == [1, 1, 1, 0, 0, 2]
    x, y = model.languages.index("x"), model.languages.index("y")
    assert means[0, x] > means[0, y] and means[1, x] > means[1, y] and means[5, y] > means[5, x]
    assert means[0, x] > means[1, x] > means[2, x] and means[2, x] == means[2, y]


def test_edge_cases(spark):
    rows = [(k, "eins zwei drei" if k % 2 else "un deux trois", "de" if k % 2 else "fr", "clash") for k in range(1, 60)]
    rows += [(101, None, "de", "c"), (102, "", "de", "c"), (103, "123 !?", "de", "c"), (104, "zwei " * 100_000, None, "c"), (105, "日本", "de", "c"), (None, "deux", "fr", "c"), (106, "deux", None, "c"), (106, "deux", None, "c")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = [r for r in identify(table, learn(table)).collect()]
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert [by_id[k].lang_pred for k in (101, 102, 103)] == ["und"] * 3 and by_id[101].score == 0
    assert by_id[104].lang_pred == "de" and by_id[106].lang_pred == "fr" and by_id[None].lang_pred == "fr"
    assert by_id[105].lang_pred in ("de", "fr") and not by_id[None].held_out
    empty = table.limit(0)
    assert identify(empty, learn(empty)).count() == 0
    assert {r.lang_pred for r in identify(table, learn(empty)).collect()} == {"und"}


def test_letters_and_table():
    letters = Letters(["Ab1c", "", "É é"])
    assert np.diff(letters.first).tolist() == [2, 0, 2]
    words = letters.words()
    assert words[2] == words[3] and len(set(words.tolist())) == 3
    keys = np.random.default_rng(1).integers(1, 1 << 62, 5000).astype(np.uint64)
    keys[1:40] = (keys[0] & np.uint64(255)) + (np.arange(1, 40, dtype=np.uint64) << np.uint64(40))  # these collide
    keys = np.unique(keys)
    table = Table(keys)
    assert (table.find(keys) == np.arange(len(keys))).all() and (table.find(keys + np.uint64(1))[:50] != np.arange(50)).all()
