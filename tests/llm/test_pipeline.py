"""The pipeline on a small table, each stage against what it must do to its own input."""

import corpus_pipeline
from tidegraph.llm.minhash import near_duplicates
from tidegraph.llm.sentencepieces import Vocabulary, decode, default_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash", "secrets", "mixing", "sentencepieces"]


def test_each_stage_acts_on_its_input(spark, tmp_path):
    docs = []
    for k in range(1, 301):
        plain = " ".join(f"w{k}x{i}" for i in range(30))
        text = f"{plain} rotten scoundrel. {plain}" if k % 5 == 0 else plain
        docs.append((k, text, "en", "a" if k % 3 else "b", len(text)))
    same = docs[0][1]
    docs += [(400 + k, same, "en", "a", len(same)) for k in range(20)] + [(500, "password=abcdefgh tail", "en", "b", 22), (501, None, None, None, None), (502, "", "en", "b", 0)]
    labels = [(k, 1, int(k % 5 == 0)) for k in range(1, 301)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    table, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, table, str(tmp_path)).write.parquet(str(tmp_path / name))
        table = spark.read.parquet(str(tmp_path / name))
        seen[name] = table
        if name != "sentencepieces":
            assert table.columns == COLUMNS
    clean = {k for k, *_ in docs} - {k for k in range(1, 301) if k % 5 == 0}
    assert {r.doc_id for r in seen["toxicity"].collect()} == clean
    once = clean - {400 + k for k in range(20)}
    assert sorted(r.doc_id for r in seen["minhash"].collect()) == sorted(once)
    cut = {r.doc_id: r for r in seen["secrets"].collect()}
    assert set(cut) == once and cut[500].text == "[SECRET] tail" and cut[500].n_chars == 13 and cut[1].text == same
    assert {r.doc_id for r in seen["mixing"].collect()} <= once
    texts = sorted(((r.doc_id, r.text or "") for r in seen["mixing"].collect()))
    back = decode(seen["sentencepieces"], Vocabulary.load(default_model()))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == texts
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, ran.select("doc_id", "ids").collect())) == sorted(map(str, seen["sentencepieces"].select("doc_id", "ids").collect()))


def test_the_stage_takes_out_copies_between_80_and_85_percent(spark):
    docs = []
    for k in range(12):
        words = [f"w{k}x{i}" for i in range(104)]  # 100 shingles
        edited = [*words[:50], "edit", *words[51:]] if k % 2 else [*words[:-10], *(f"tail{i}" for i in range(10))]
        docs += [(2 * k, " ".join(words), 0), (2 * k + 1, " ".join(edited), 0)]
    # 5 of 100 changed: 95/105; 10 of 100 changed: 90/110 = 0.82
    table = spark.createDataFrame(docs, "doc_id long, text string, n_chars int")
    kept = sorted(r.doc_id for r in corpus_pipeline.minhash_stage(spark, table, "").collect())
    assert kept == list(range(0, 24, 2))
    low = near_duplicates(table).filter("kept").count()
    assert low == 18  # the query of its own links from 85 percent
