"""Near-duplicate vectors by a pivot-permutation index and exact cosines.

Every vector is described by its `NEAREST` nearest of `PIVOTS` reference points.
Inverted lists hold the vectors of a label under each set of `SHARED`
reference points among those, so two vectors meet in a list just if they
share that many; the cosine on the original vectors in double precision decides. A pair that meets in
several lists counts in one only, that of its least shared reference points.

Equal vectors of a label collapse into one class first. A long list is
cut into blocks, and every pair of blocks is a group of its own of at
most about `2 * BLOCK` vectors; a group gives link counts and a spanning forest of its links, never
its pairs.

The reference points are chosen, far from each other, from a sample of at most `SAMPLE`
vectors; every vector is indexed. Two vectors at a cosine of exactly 0.98 share
enough reference points with a chance above 0.998 on isotropic data.

Vectors that are null, empty, zero or hold null or non-finite components, and rows
without label or id, link with nothing; so do vectors of unequal length.
Rows that share an id are told apart by their vectors but join one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.lineage import cut
from tidegraph.llm.base import map_batches, map_rows
from tidegraph.llm.components import components

PIVOTS, NEAREST, SHARED = 256, 7, 3
SAMPLE = 4096
BLOCK = 1024
COSINE = 0.98
_COMBOS = np.array(list(combinations(range(NEAREST), SHARED)))


def matrix(column: pa.ChunkedArray, dim: int, kind: type = np.float64) -> np.ndarray:
    """The vectors of a column, all of length `dim`, as rows."""
    return np.asarray(pc.list_flatten(column).to_numpy(), kind).reshape(-1, dim)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which is exact, so that neither products nor norms leave the range of doubles."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(embedding: str) -> str:
    """SQL for a vector that has a direction."""
    finite = f"forall({embedding}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    return f"coalesce(size({embedding}) > 0 AND {finite} AND exists({embedding}, x -> x <> 0), false)"


def farthest(points: np.ndarray, count: int) -> np.ndarray:
    """`count` unit vectors far from each other; random ones make up for a sample that is too small."""
    dim = points.shape[1]
    extra = unit(np.random.default_rng(dim).normal(size=(count, dim)))
    points = np.vstack([unit(points), extra]) if len(points) < count else unit(points)
    chosen, best = [0], points @ points[0]
    while len(chosen) < count:
        chosen.append(int(best.argmin()))
        best = np.maximum(best, points @ points[chosen[-1]])
    return points[chosen]


def reference_points(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Reference points per vector length, from the `SAMPLE` vectors of the least hashed ids."""
    rows = vectors.select("node", "embedding").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).collect()
    by_dim: dict[int, list] = {}
    for r in rows:
        by_dim.setdefault(len(r.embedding), []).append(r.embedding)
    return {dim: farthest(np.array(x, np.float64), PIVOTS) for dim, x in by_dim.items()}


def described(vectors: DataFrame, points: dict[int, np.ndarray]) -> DataFrame:
    """(node, label, dim, copies, embedding, top): `top` holds the nearest reference points, smallest number first."""

    def step(rows: pa.Table) -> pa.Table:
        dims = pc.list_value_length(rows["embedding"]).to_numpy()
        top = np.zeros((len(dims), NEAREST), np.int16)
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            known = points.get(int(dim))
            if known is None:
                known = farthest(np.ones((1, int(dim))), PIVOTS)
            x = unit(matrix(rows["embedding"].take(pa.array(at)), int(dim)))
            nearest = np.argpartition(-(x @ known.T), NEAREST - 1, axis=1)[:, :NEAREST]
            top[at] = np.sort(nearest, axis=1)
        return rows.append_column("dim", pa.array(dims, pa.int32())).append_column(
            "top", pa.array(list(top), pa.list_(pa.int16()))
        )

    return map_rows(
        vectors.select("node", "label", "copies", "embedding"),
        step,
        "node long, label long, copies long, embedding array<double>, dim int, top array<short>",
    )


def _posting_keys(top: str) -> str:
    """SQL for the keys of all sets of `SHARED` reference points of a description."""
    keys = [" + ".join(f"{top}[{k}] * {PIVOTS ** (SHARED - 1 - i)}L" for i, k in enumerate(c)) for c in _COMBOS]
    return f"array({', '.join(keys)})"


def _group_links(rows: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Link counts (node, 0, n) and forest edges (a, b, -1) of one pair of blocks of one list."""
    node, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
    block, first, second = rows["block"].to_numpy(), rows["first"][0].as_py(), rows["second"][0].as_py()
    key, dim = rows["key"][0].as_py(), rows["dim"][0].as_py()
    x = scaled(matrix(rows["embedding"], dim))
    size = np.linalg.norm(x, axis=1)
    sides = [np.flatnonzero(block == first), np.flatnonzero(block == second)] if first != second else [np.arange(len(node))] * 2
    last = key % PIVOTS
    has = np.zeros((len(node), PIVOTS), np.float32)
    has[np.arange(len(node))[:, None], matrix(rows["top"], NEAREST, np.int64)] = 1
    upto = has[:, : last + 1]
    a, b = sides
    linked = (x[a] @ x[b].T) / size[a][:, None] / size[b][None, :] >= COSINE
    linked &= upto[a] @ upto[b].T == SHARED  # the least shared points are those of this list
    if first == second:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return [], []
    counts = [np.c_[node[a], np.zeros(len(a), np.int64), linked @ copies[b]]]
    if first != second:
        counts.append(np.c_[node[b], np.zeros(len(b), np.int64), linked.T @ copies[a]])
        whole = np.zeros((len(node), len(node)), bool)
        whole[np.ix_(a, b)] = linked
        linked = whole | whole.T
    edges, unseen = [], linked.any(axis=1)
    for start in range(len(node)):
        if not unseen[start]:
            continue
        unseen[start], border = False, [start]
        while border:
            at = border.pop()
            fresh = np.flatnonzero(linked[at] & unseen)
            unseen[fresh] = False
            border += fresh.tolist()
            edges.append(np.c_[np.full(len(fresh), node[at]), node[fresh], np.full(len(fresh), -1)])
    return [c[c[:, 2] > 0] for c in counts], edges


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of a sorted partition, one after another; only the last group of a batch waits for the next."""
    waiting, names = None, ["label", "dim", "key", "first", "second"]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def results(rows: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = [np.zeros((0, 3), np.int64)]
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            if j - i > 1:
                counts, edges = _group_links(rows.slice(i, j - i))
                found += counts + edges
        out = np.concatenate(found)
        yield pa.RecordBatch.from_arrays([pa.array(out[:, k]) for k in range(3)], schema=schema)

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if waiting is not None:
            rows = pa.concat_tables([waiting, rows]).combine_chunks()
        keys = np.stack([rows[c].to_numpy() for c in names], axis=1)
        starts = np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1)
        yield from results(rows, starts)
        waiting = rows.slice(starts[-1]) if len(rows) else None
    if waiting is not None:
        yield from results(waiting, np.array([0, len(waiting)]))


def near_vectors(embeddings: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per row: vec_id, n_links (other rows linked directly), component_id and kept."""
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    able = F.expr(usable("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    keyed = rows.select(
        "vec_id",
        "label",
        F.when(able, F.col("embedding")).alias("embedding"),
        F.when(able, F.xxhash64("label", "embedding")).alias("h1"),
        F.when(able, F.xxhash64(F.lit(7), "embedding", "label")).alias("h2"),
    )
    classes = cut(
        keyed.filter("h1 IS NOT NULL")
        .groupBy("h1", "h2")
        .agg(F.min(F.struct("vec_id", "label", "embedding")).alias("one"), F.count(F.lit(1)).alias("copies"))
        .select("h1", "h2", "copies", F.col("one.vec_id").alias("node"), "one.label", "one.embedding")
    )
    vectors = cut(described(classes, reference_points(classes)))
    postings = vectors.select("node", "label", "dim", F.expr(f"explode({_posting_keys('top')}) AS key"))
    lists = postings.groupBy("label", "dim", "key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    blocks = F.ceil(F.col("members") / block).cast("int")
    placed = (
        postings.join(lists, ["label", "dim", "key"])
        .withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            "node",
            "label",
            "dim",
            "key",
            F.least("block", "other").alias("first"),
            F.greatest("block", "other").alias("second"),
            "block",
        )
    )
    group = ["label", "dim", "key", "first", "second"]
    filled = placed.join(vectors.select("node", "copies", "embedding", "top"), "node")
    dealt = filled.select(*group, "block", "node", "copies", "embedding", "top").repartition(*group)
    found = cut(map_batches(dealt.sortWithinPartitions(*group), _links, "a long, b long, n long"))
    counts = found.filter("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    joined = components(found.filter("n < 0").select("a", "b"))
    told = (
        classes.select("h1", "h2", "node", "copies")
        .join(counts, "node", "left")
        .join(joined, "node", "left")
        .select(
            "h1",
            "h2",
            (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
            F.coalesce("component", "node").alias("component"),
        )
    )
    return (
        keyed.select("vec_id", "h1", "h2")
        .join(told, ["h1", "h2"], "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
