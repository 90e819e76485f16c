import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph.llm.hilbert import curve_keys, nearest_vectors

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("axes", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_the_curve_visits_every_cell_by_single_steps(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    keys = curve_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def brute(rows, nearest):
    out = []
    for q, a in rows.items():
        if q % 20 == 0:
            scores = sorted(((-float(np.dot(a, b)), i) for i, b in rows.items() if i != q and len(a) == len(b)))[:nearest]
            out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    return out


def test_recall_and_scores_on_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in table.collect()}
    found = nearest_vectors(table, F.col("vec_id") % 20 == 0).collect()
    want = {(q, i): s for q, _, i, s in brute(rows, 20)}
    assert all(abs(r.score - float(np.dot(rows[r.query_id], rows[r.vec_id]))) < 1e-12 for r in found)
    assert len({(r.query_id, r.vec_id) for r in found} & set(want)) >= 0.9 * len(want)
    assert len(found) == len(want)


def test_a_whole_window_is_exact_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    vectors = {k: rng.normal(size=5).round(1).tolist() for k in range(60)} | {k: [1.0, 2.0] for k in range(100, 106)}
    vectors[7] = vectors[8] = vectors[9]
    rows = [(k, v) for k, v in vectors.items()] + [(3, vectors[3])]
    bad = [(200, None), (220, [0.0, 0.0]), (201, [float("nan"), 1.0]), (202, [float("inf"), 1.0]), (203, [None, 1.0]), (None, [1.0, 2.0]), (204, [])]
    table = spark.createDataFrame([(k, v, 0.5) for k, v in rows + bad], "vec_id long, embedding array<double>, rank double")
    found = nearest_vectors(table, F.col("vec_id") % 20 == 0, nearest=8, window=1.0).collect()
    # row 3 comes twice and is a candidate twice
    want = []
    for q in (k for k in vectors if k % 20 == 0):
        others = [(-float(np.dot(vectors[q], v)), k) for k, v in rows if k != q and len(v) == len(vectors[q])]
        want += [(q, n + 1, k) for n, (_, k) in enumerate(sorted(others)[:8])]
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found) == sorted(want)
    assert max(r["rank"] for r in found if r.query_id == 100) == 5
    assert nearest_vectors(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_small_groups_fill_every_rank_with_the_default_window(spark):
    rng = np.random.default_rng(4)
    sizes = {1000 * n: n for n in [*range(2, 41), 100, 400]}  # a vector length of its own for each size
    vectors = {first + k: rng.normal(size=n + 2) for first, n in sizes.items() for k in range(n)}
    table = spark.createDataFrame([(k, v.tolist()) for k, v in vectors.items()], "vec_id long, embedding array<double>")
    found = nearest_vectors(table, F.col("vec_id") >= 0).collect()
    ranks = {}
    for r in found:
        ranks.setdefault(r.query_id, []).append(r["rank"])
    assert {k: sorted(r) for k, r in ranks.items()} == {k: list(range(1, min(20, sizes[k // 1000 * 1000] - 1) + 1)) for k in vectors}
    small = {k: v for k, v in vectors.items() if k < 41_000}
    want = {(q, k, i) for q, k, i, _ in brute(small, 20)}
    assert {(r.query_id, r["rank"], r.vec_id) for r in found if r.query_id % 20 == 0 and r.query_id in small} == want


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 2.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0])]
    found = nearest_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    per_query = [[(20, 0.0), (20, 0.0), (1, 1.0)], *[[(20, 0.0), (20, 4.0), (1, 2.0)]] * 2]
    assert sorted((r.query_id, r["rank"], r.score) for r in found) == sorted(
        (20, k + 1, s) for each in per_query for k, s in enumerate(sorted((s for _, s in each), reverse=True))
    )


@pytest.mark.parametrize("size", [2.0**-560, 2.0**-20, 2.0**530])
def test_vectors_of_any_magnitude(spark, size):
    rng = np.random.default_rng(6)
    near = {k: rng.normal(size=8) for k in range(60)}
    table = spark.createDataFrame([(k, (v * size).tolist()) for k, v in near.items()], "vec_id long, embedding array<double>")
    found = nearest_vectors(table, F.col("vec_id") % 20 == 0, nearest=5, window=1.0).collect()
    assert len(found) == 15 and not any(np.isnan(r.score) for r in found)
    if size == 2.0**-20:
        assert {(r.query_id, r["rank"], r.vec_id) for r in found} == {(q, k, i) for q, k, i, _ in brute(near, 5)}
        assert all(r.score == np.einsum("d,d", near[r.query_id] * size, near[r.vec_id] * size) for r in found)
    elif size > 1:  # beyond the range of doubles: infinite, ties to the smaller id
        first = {r.query_id: r.vec_id for r in found if r["rank"] == 1}
        for q in (0, 20, 40):
            assert first[q] == min(k for k in near if k != q and np.dot(near[q], near[k]) > 0.5)


def test_large_cancelling_components_do_not_hide_a_neighbour(spark):
    rows = [(0, [2.0**20, 2.0**20, 1.0])] + [(k, [2.0**20, -(2.0**20), float(k)]) for k in range(1, 50)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nearest_vectors(table, F.col("vec_id") == 0, nearest=3, window=1.0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(49, 49.0), (48, 48.0), (47, 47.0)]
