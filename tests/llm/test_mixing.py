import math

import pytest

from tidegraph.llm.mixing import mix, rates


def documents(spark, counts):
    rows = [(k * 100_000 + n, f"text {n}", source) for k, (source, many) in enumerate(counts.items()) for n in range(many)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnRenamed("text", "text")


def test_shares_meet_the_weights(spark):
    docs = documents(spark, {"a": 6000, "b": 1500, None: 500})
    mixed = mix(docs, {"a": 1, "b": 1, None: 2}).groupBy("source").count().collect()
    got = {r.source: r["count"] for r in mixed}
    for source, share in (("a", 0.25), ("b", 0.25), (None, 0.5)):
        want = share * 8000
        assert abs(got[source] - want) < 5 * math.sqrt(want * max(1, want / 500))


def test_copies_are_poisson_and_repeatable(spark):
    docs = documents(spark, {"a": 4000, "b": 4000})
    counts = mix(docs, {"a": 3, "b": 1}).filter("source = 'a'").groupBy("doc_id").count()
    seen = {r["count"]: r.n for r in counts.groupBy("count").agg({"*": "count"}).toDF("count", "n").collect()}
    seen[0] = 4000 - sum(seen.values())
    for k in range(5):
        want = 4000 * math.exp(-1.5) * 1.5**k / math.factorial(k)
        assert abs(seen.get(k, 0) - want) < 5 * math.sqrt(want)
    first, again = mix(docs).collect(), mix(docs.repartition(7)).collect()
    assert sorted(first) == sorted(again)


def test_high_rates_are_sums_of_parts(spark):
    docs = documents(spark, {"big": 4000, "small": 10})
    assert rates(docs).filter("source = 'small'").first().chunks > 1
    total = mix(docs).filter("source = 'small'").count()
    assert abs(total - 2005) < 5 * math.sqrt(2005)


def test_order_is_global_and_mixed(spark):
    places = [r._place for r in mix(documents(spark, {"a": 300, "b": 300})).collect()]
    assert places == sorted(places)


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(empty).count() == 0
    odd = spark.createDataFrame([(None, None, None, 1.0), (1, "", "s", 2.0), (1, "", "s", 2.0)], "doc_id long, text string, source string, rate double")
    counts = [r["count"] for r in mix(odd.filter("doc_id = 1")).groupBy("_copy").count().collect()]
    assert all(c == 2 for c in counts)
    assert "rate" in mix(odd).columns
    assert mix(odd, {"absent": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mix(odd, {"s": -1.0})
