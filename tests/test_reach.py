"""Of the log a poll ranks only what some feed can get."""

import random

from pyspark.sql import functions as F

from tidegraph.operators import polling as pl
from tidegraph.sources import retail

SF = "/root/testdata/sf0.001"
CURSOR = "id string, type_filter array<string>, max_ack long, from_ack long, parent_max_ack long, inflight array<long>, buffer long"


def log_of(spark, rows):
    return spark.createDataFrame([(t, f"{t}-{s}", s) for t, s in rows], "type string, id string, seq long").withColumn("event_time", F.lit("x"))


def feed(name, types, start, upto, room):
    return (name, types, start, start, upto, [], room)


def test_rows_that_no_feed_gets_are_not_ranked(spark, monkeypatch):
    log = log_of(spark, [("a", s) for s in range(1, 20_001)] + [("b", 20_001)])
    cursors = spark.createDataFrame([feed("near", ["a"], 10, 20_001, 5), feed("late", ["a"], 3_000, 20_001, 7), feed("rare", ["b"], 0, 20_001, 7)], CURSOR)
    ranked, numbered = [], pl.running_count
    monkeypatch.setattr(pl, "running_count", lambda df, *more: (ranked.append(df.filter("kind = 0").count()), numbered(df, *more))[1])
    got = sorted((r["feed"], r["seq"]) for r in pl.poll(cursors, log).collect())
    assert got == sorted([("near", s) for s in range(11, 16)] + [("late", s) for s in range(3_001, 3_008)] + [("rare", 20_001)])
    assert ranked[0] == 8_191 - 10 + 1  # the block after that of position 3,000 fills every room


def test_poll_equals_a_search_feed_by_feed(spark, monkeypatch):
    monkeypatch.setattr(pl, "BLOCK_BITS", 2)
    rng = random.Random(5)
    rows = [(rng.choice("aaaaaabbc"), s) for s in range(-20, 300) if rng.random() < 0.7]
    filters = [None, [], ["a"], ["b", "c"], ["c", None, "c"], ["none"], ["a", "b", "none"]]
    feeds = []
    for k in range(60):
        start = rng.randrange(-25, 310)
        feeds.append(feed(f"f{k}", rng.choice(filters), start, start + rng.choice([0, 3, 40, 400]), rng.choice([1, 2, 9, 500])))
    expected = set()
    for name, types, _, start, upto, _, room in feeds:
        seen = sorted(s for t, s in rows if start < s <= upto and (types is None or t in types))
        expected |= {(name, s) for s in seen[:room]}
    got = [(r["feed"], r["seq"]) for r in pl.poll(spark.createDataFrame(feeds, CURSOR), log_of(spark, rows)).collect()]
    assert len(got) == len(expected)
    assert set(got) == expected


def test_newest_updates_are_the_log_compacted(spark, capsys):
    newest = retail.newest_updates(spark, SF)
    newest.explain()
    assert "Generate" not in capsys.readouterr().out
    whole = retail.log_updates(spark, SF).groupBy("type", "id").agg(F.max("event_time").alias("event_time"))
    assert newest.count() == whole.count()
    assert newest.exceptAll(whole).count() == 0
