"""Approximate nearest neighbours on shifted space-filling curves.

Vectors are rotated at random, projected to `AXES` coordinates, shifted and ordered along a Hilbert
curve, several times with other rotations and shifts.  Spark range-partitions every
ordering by curve key and numbers it, which cuts it into `CELLS` cells of equal size.  A query meets the
cells within its window of each ordering; a cell's vectors stream past a block of queries, which keeps the best
so far, and the cells' best merge and are ranked by their exact inner product in double precision.

`window` is the share of an ordering that a query looks at, but never fewer than `LEAST` * (nearest + 1) places, or all of a
shorter ordering; so every rank is filled that has a candidate.  Clustered data needs
little of it.  Vectors spread evenly in 64 dimensions have no neighbourhood that a few
coordinates could show, and a recall above 0.9 takes wide windows: see the README for figures.

Rotations and shifts are fixed; scale and centre come from a sample of at most `SAMPLE` vectors.  Every vector
is indexed.  Vectors that are null, empty, zero or hold null or non-finite components, and rows without id, take no part;
vectors of unequal length don't meet.  Every row is a candidate and, if asked for, a query of its own, also
where ids repeat; a row is never its own neighbour.  Products are taken on vectors scaled by powers of two, which changes no
bit of an ordinary score; a score beyond the range of doubles is infinite, never NaN, and ties there go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.lineage import cut
from tidegraph.llm.base import map_batches, map_rows
from tidegraph.llm.pivots import matrix, usable
from tidegraph.operators.ordering import with_sequence

CURVES, AXES, BITS = 3, 4, 15
WINDOW, LEAST = 0.55, 4
CELLS, QUERY_BLOCK = 16, 4096
NEAREST = 20
SAMPLE = 4096
_erf = np.vectorize(erf, otypes=[float])


def curve_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of grid cells (rows of coordinates below 2**bits).

    Coordinates are untangled from the highest bit down: each bit of each axis
    reflects or swaps the first axis, then the axes are Gray-coded together and their bits woven into one number.
    """
    x = [c.astype(np.uint64) for c in cells.T]
    zero, one = np.uint64(0), np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit = np.uint64(1 << level)
        low = bit - one
        for axis in range(len(x)):
            high = (x[axis] & bit) != zero
            swap = np.where(high, zero, (x[0] ^ x[axis]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if axis:
                x[axis] = x[axis] ^ swap
    for axis in range(1, len(x)):
        x[axis] = x[axis] ^ x[axis - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        bit = np.uint64(1 << level)
        turn = np.where((x[-1] & bit) != zero, turn ^ (bit - one), turn)
    key = np.zeros_like(turn)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << one) | (((axis ^ turn) >> np.uint64(level)) & one)
    return key.astype(np.int64)


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled by powers of two to a largest component in [0.5, 1), and the exponents taken out."""
    powers = np.frexp(np.abs(x).max(axis=1, initial=0.0))[1]
    return np.ldexp(x, -powers[:, None]), powers


class Curve:
    """A rotation, a shift, and the centre and scale of the projected coordinates."""

    def __init__(self, number: int, sample: np.ndarray) -> None:
        random = np.random.default_rng([number, sample.shape[1]])
        turned = np.linalg.qr(random.normal(size=(sample.shape[1], sample.shape[1])))[0]
        self.axes = turned[:, :AXES]
        self.shift = random.random(self.axes.shape[1])
        self.power = int(np.frexp(np.abs(sample).max(initial=0.0))[1])
        seen = np.ldexp(sample, -self.power) @ self.axes
        self.centre, self.scale = seen.mean(axis=0), np.maximum(seen.std(axis=0), 1e-12)

    def keys(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            seen = (np.ldexp(x, -self.power) @ self.axes - self.centre) / self.scale / np.sqrt(2)
        even = 0.5 * (1 + _erf(np.nan_to_num(seen)))  # about uniform on (0, 1)
        return curve_keys(np.minimum((even + self.shift) / 2 * (1 << BITS), (1 << BITS) - 1).astype(np.int64))


def curves_of(vectors: DataFrame, count: int) -> dict[int, list[Curve]]:
    """The curves per vector length, fitted on the vectors of the least hashed ids (`SAMPLE` rows at most)."""
    rows = vectors.select("row", "embedding").orderBy(F.xxhash64("vec_id"), "row").limit(SAMPLE).collect()
    by_dim: dict[int, list] = {}
    for r in rows:
        by_dim.setdefault(len(r.embedding), []).append(r.embedding)
    return {dim: [Curve(k, np.array(x, np.float64)) for k in range(count)] for dim, x in by_dim.items()}


def _keyed(vectors: DataFrame, curves: dict[int, list[Curve]], count: int) -> DataFrame:
    """(row, dim, curve, key): every vector's place on every curve."""

    def step(rows: pa.Table) -> pa.Table:
        dims = pc.list_value_length(rows["embedding"]).to_numpy()
        keys = np.zeros((len(dims), count), np.int64)
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            x = matrix(rows["embedding"].take(pa.array(at)), int(dim))
            own = curves.get(int(dim)) or [Curve(k, np.eye(int(dim))) for k in range(count)]
            keys[at] = np.stack([c.keys(x) for c in own], axis=1)
        return pa.table(
            {
                "row": rows["row"].combine_chunks().take(pa.array(np.repeat(np.arange(len(dims)), count))),
                "dim": np.repeat(dims, count).astype(np.int32),
                "curve": np.tile(np.arange(count, dtype=np.int32), len(dims)),
                "key": keys.ravel(),
            }
        )

    return map_rows(vectors.select("row", "embedding"), step, "row long, dim int, curve int, key long")


Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def _nearest(found: Found, nearest: int) -> Found:
    """Of (query, candidate, score) the nearest per query."""
    query, candidate, score = found
    order = np.lexsort([candidate, -score, query])
    query, candidate, score = query[order], candidate[order], score[order]
    first = np.arange(len(query)) - np.searchsorted(query, query) < nearest
    return query[first], candidate[first], score[first]


def _best(queries: pa.Table, candidates: pa.Table, nearest: int) -> Found:
    """The nearest of some candidates for each query."""
    dim = queries["dim"][0].as_py()
    q, q_power = scaled(matrix(queries["embedding"], dim))
    c, c_power = scaled(matrix(candidates["embedding"], dim))
    q_id, c_id = queries["row"].to_numpy(), candidates["row"].to_numpy()
    close = q_id[:, None] != c_id[None, :]
    with np.errstate(over="ignore", under="ignore"):
        if len(c_id) > nearest:
            powers = q_power[:, None] + c_power[None, :]
            rough = q @ c.T
            slack = 1e-12 * dim * np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :]  # far above rounding
            least = np.where(close, np.ldexp(rough - slack, powers), -np.inf)
            last = np.partition(least, len(c_id) - nearest, axis=1)[:, len(c_id) - nearest]
            close &= np.ldexp(rough + slack, powers) >= last[:, None]
        row, column = np.nonzero(close)
        # the same sum for equal vectors, wherever they stand
        score = np.ldexp(np.einsum("kd,kd->k", q[row], c[column]), q_power[row] + c_power[column])
    return _nearest((q_id[row], c_id[column], score), nearest)


def _streamed(batches: Iterator[pa.RecordBatch], nearest: int) -> Iterator[pa.RecordBatch]:
    """Cells of a sorted partition: first a cell's queries, at most about `QUERY_BLOCK`, then its vectors in batches."""
    names, schema = ["dim", "curve", "cell", "block"], pa.schema([("query_row", pa.int64()), ("row", pa.int64()), ("score", pa.float64())])
    key, queries, found = None, [], None

    def told() -> Iterator[pa.RecordBatch]:
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], schema=schema)

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        keys = np.stack([rows[c].to_numpy() for c in [*names, "candidate"]], axis=1).astype(np.int64)
        starts = np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1) if len(rows) else []
        for i, j in zip(starts, [*starts[1:], len(rows)], strict=True):
            if key != tuple(keys[i, :-1]):
                yield from told()
                key, queries, found = tuple(keys[i, :-1]), [], None
            part = rows.slice(i, j - i)
            if not keys[i, -1]:
                queries.append(part)
            elif queries:
                queries = [pa.concat_tables(queries).combine_chunks()]
                best = _best(queries[0], part.combine_chunks(), nearest)
                found = best if found is None else _nearest(tuple(map(np.concatenate, zip(found, best, strict=True))), nearest)
    yield from told()


def nearest_vectors(
    embeddings: DataFrame,
    is_query: Column,
    nearest: int = NEAREST,
    window: float = WINDOW,
    curves: int = CURVES,
    cells: int = CELLS,
) -> DataFrame:
    """Per query (query_id, rank, vec_id, score): its `nearest` nearest found, by inner product, ties to the smaller id."""
    rows = embeddings.filter(F.expr(usable("embedding")) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), "embedding"
    )
    # Rows are numbered in the order of ids, so that numbers stand in for them and break ties alike.
    vectors = cut(with_sequence(rows, ["vec_id", "embedding"], "row"))
    keyed = _keyed(vectors, curves_of(vectors, curves), curves)
    ordered = with_sequence(keyed, ["dim", "curve", "key", "row"], "number")
    sizes = ordered.groupBy("dim", "curve").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("rows"))
    placed = cut(
        ordered.join(F.broadcast(sizes), ["dim", "curve"])  # a row per vector length and curve
        .withColumn("rank", F.col("number") - F.col("first"))
        .select("row", "dim", "curve", "rank", "rows")
    )
    wide = F.least(F.col("rows"), F.greatest(F.lit(LEAST * (nearest + 1)), F.ceil(F.col("rows") * window)))
    low = F.greatest(F.lit(0), F.least(F.col("rank") - F.floor(wide / 2), F.col("rows") - wide))
    asked = placed.join(vectors.filter(is_query), "row")
    blocks = max(1, -(-vectors.filter(is_query).count() // QUERY_BLOCK))
    group = ["dim", "curve", "cell", "block"]
    queries = asked.select(
        "row",
        "dim",
        "curve",
        F.explode(F.sequence(F.floor(low * cells / F.col("rows")), F.floor((low + wide - 1) * cells / F.col("rows")))).alias("cell"),
        F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"),
        F.lit(False).alias("candidate"),
        "embedding",
    )
    candidates = placed.join(vectors, "row").select(
        "row",
        "dim",
        "curve",
        F.floor(F.col("rank") * cells / F.col("rows")).alias("cell"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.lit(True).alias("candidate"),
        "embedding",
    )
    dealt = queries.unionByName(candidates).repartition(*group).sortWithinPartitions(*group, "candidate")
    found = map_batches(dealt, lambda rows: _streamed(rows, nearest), "query_row long, row long, score double")
    by_score = Window.partitionBy("query_row").orderBy(F.desc("score"), "row")
    # A candidate comes once per curve at most, so this many rows hold the nearest; Spark cuts to them before the shuffle.
    few = found.withColumn("_at", F.row_number().over(by_score)).filter(F.col("_at") <= nearest * curves)
    once = few.dropDuplicates(["query_row", "row"])
    ranked = once.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= nearest)
    ids = vectors.select("row", "vec_id")
    return (
        ranked.join(ids, "row")
        .join(ids.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id")), "query_row")
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
