import random
import zlib

import numpy as np

from tidegraph.llm.sharding import Totals, cuts, shard_rows


def smallest_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, used, filled = (low + high) // 2, 1, 0
        for s in sizes:
            used, filled = (used, filled + s) if filled + s <= middle else (used + 1, s)
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


def greedy(sizes, capacity, shards):
    ends, total, filled = [], 0, 0
    for s in sizes:
        if filled + s > capacity:
            ends.append(total)
            filled = 0
        filled, total = filled + s, total + s
    return (ends + [total] * shards)[:shards]


def test_cuts_are_exact_with_few_knots(spark):
    random.seed(3)
    for case in range(3):
        sizes = [random.choice([1, 2, 5, 40, 400 if case else 7]) for _ in range(700)]
        if case == 2:
            sizes[300] = 9000
        ends = np.cumsum(sizes).tolist()
        groups = spark.createDataFrame(list(zip(sizes, ends, strict=True)), "size long, end long").coalesce(1).cache()
        capacity, found = cuts(groups, 8, knots=64)
        assert capacity == smallest_capacity(sizes, 8)
        assert found == greedy(sizes, capacity, 8)


def test_totals_read_gaps_both_ways():
    known = Totals(np.array([10, 30, 35]), np.array([False, True, False]))
    assert known.reach(0, 9) == (0, 0, 0) and known.reach(0, 12) == (10, 12, 2) and known.reach(0, 40) == (35, 35, 0)


def test_rows(spark):
    random.seed(5)
    texts = ["x" * random.randint(0, 50) for _ in range(300)] + [None, "", "é🙂", "same" * 50] + ["same" * 50] * 60
    rows = [(k, t, "clash") for k, t in enumerate(texts)] + [(None, "no id", "c"), (3, texts[3], "c")]
    out = shard_rows(spark.createDataFrame(rows, "doc_id long, text string, shard string"), knots=16).collect()
    assert len(out) == len(rows) and {r.law for r in out} == {"bytes"} and {r.grown_shard for r in out} == {None}
    first, size, shard = {}, {}, {}
    for k, t, _ in rows:
        t = t or ""
        size[t] = size.get(t, 0) + len(t.encode()) + 1
        first[t] = min(first.get(t, float("inf")), float("inf") if k is None else k)
    by_id = {}
    for r in out:
        by_id.setdefault(r.doc_id, r)
        assert 0 <= r.shard < 8
    for k, t, _ in rows:
        r = by_id[k]
        assert r.size == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32((t or "").encode())
        assert shard.setdefault(t or "", r.shard) == r.shard
    order = sorted(size, key=lambda t: first[t])
    assert [shard[t] for t in order] == sorted(shard[t] for t in order)
    loads = [sum(size[t] for t in order if shard[t] == k) for k in range(8)]
    assert max(loads) == smallest_capacity([size[t] for t in order], 8)
    for k in range(8):
        slots = sorted(r.slot for r in out if r.shard == k)
        assert slots == list(range(len(slots)))


def test_an_empty_table(spark):
    assert shard_rows(spark.createDataFrame([], "doc_id long, text string")).count() == 0
