import numpy as np
import pytest

from tidegraph.llm.pivots import near_vectors


def brute(rows):
    """Per row (vec_id, n_links, component) of rows (vec_id, label, vector)."""
    def able(label, v):
        return label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    linked = [[] for _ in rows]
    for i, (_, la, a) in enumerate(rows):
        for j, (_, lb, b) in enumerate(rows):
            if i != j and la == lb and able(la, a) and able(lb, b) and len(a) == len(b):
                if np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                    linked[i].append(j)
    least = [r[0] for r in rows]
    for _ in rows:
        least = [min([least[i], *(least[j] for j in linked[i])]) for i in range(len(rows))]
    return sorted((r[0], len(linked[i]), least[i]) for i, r in enumerate(rows))


def near(rng, v, cosine):
    noise = rng.normal(size=len(v))
    noise -= noise @ v * v
    return cosine * v + np.sqrt(1 - cosine**2) * noise / np.linalg.norm(noise)


@pytest.mark.parametrize("block", [1024, 7])
def test_links_equal_brute_force(spark, block):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(120):
        v = rng.normal(size=16)
        rows.append((k, k % 3, v / np.linalg.norm(v)))
    for k in range(60):
        base = rows[k][2] if k > 40 else rows[0][2]
        rows.append((200 + k, rows[k][1] if k > 40 else 0, near(rng, base, rng.choice([0.97, 0.985, 0.9999]))))
    rows += [(300 + k, 1, rows[1][2] * (k + 1)) for k in range(4)] + [(310 + k, 1, rows[4][2]) for k in range(5)]
    rows = [(k, label, [float(x) for x in v]) for k, label, v in rows]
    rows += [(400, None, rows[0][2]), (401, 0, None), (402, 0, [0.0] * 16), (403, 0, [float("nan")] * 16), (404, 0, [None] * 16), (405, 0, []), (406, 0, [1.0, 2.0]), (407, 0, [2.0, 4.0])]
    table = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, label int, embedding array<double>, n_links int")
    got = near_vectors(table, block).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_empty_and_rows_without_id(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert near_vectors(spark.createDataFrame([], schema)).count() == 0
    got = near_vectors(spark.createDataFrame([(None, 1, [1.0, 0.0]), (5, 1, [1.0, 0.0])], schema)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == [("5", 0, "5", True), ("None", 0, "None", False)]


def test_very_small_and_very_large_vectors(spark):
    rows = []
    for k, size in enumerate([1.0, 1e-170, 1e170, 1e-300, 1e300]):
        rows += [(10 * k + n, k, [size * f * x for x in (3.0, -1.0, 2.0, 0.5)]) for n, f in enumerate([1.0, 2.5, 7.0])]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(k, 2, k // 10 * 10) for k, _, _ in rows]


def test_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.label, r.embedding) for r in table.collect()]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(table).collect())
    assert got == brute([(k, la, np.array(v, np.float64)) for k, la, v in rows])
