"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document's set holds its distinct shingles of five words (fewer words: the
whole sequence; none: empty).  Two permutations of the numbers below 2**32 make
every signature coordinate: the first shuffles the shingles once, the second is
applied after a circular shift by k for coordinate k, and the least value counts.
Bands of the signature are buckets; documents of a bucket are candidates, and a
link needs 100 * |A n B| >= percent * |A u B| on the full sets: 85 in `op8_minhash`, `LOOSE` = 80 where copies are
taken out of a corpus.

Equal sets collapse into one class first.  A bucket is never expanded into
all its pairs.  Three exact bounds hold the work down however large a bucket is: sizes,
shingles no other candidate has (they can't be shared), and known components.
In a first round each bucket compares its members with one pivot, the one with the least part
of its own.  After that only pairs across components that the bounds
leave open are compared, through their differences from a common third set, which are small among near copies.
No bucket is capped and no pair is sampled.

A null or empty text has the empty set and links with nothing.  Rows without an id
link with nothing and have no component.  Rows that share an id are one document for linking.

With 20 bands of 4 coordinates a pair at 85 percent is missed with a chance of 4e-7, one at 80 percent of 3e-5.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.lineage import cut
from tidegraph.llm.base import map_rows
from tidegraph.llm.components import components
from tidegraph.llm.shingles import U, mix, shingle_sets

BANDS, ROWS = 20, 4
PERCENT, LOOSE = 85, 80
_U32 = np.uint32
_TILE = 1 << 13


def _scatter(x: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection of the 32-bit numbers."""
    x ^= x >> _U32(16)
    x *= _U32(0x85EBCA6B)
    x ^= x >> _U32(13)
    x *= _U32(0xC2B2AE35)
    x ^= x >> _U32(16)
    return x


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """`size` least values: coordinate k permutes, shifts by k round the circle of 2**32, and permutes again."""
    first = (mix(shingles ^ U(0x5851F42D4C957F2D)) >> U(32)).astype(_U32)
    shifts = np.arange(size, dtype=_U32)[:, None]
    least = np.full(size, 0xFFFFFFFF, _U32)
    tile = max(1, _TILE * 16 // size)
    for at in range(0, len(first), tile):
        np.minimum(least, _scatter(first[None, at : at + tile] + shifts).min(axis=1), out=least)
    return least


def signatures(documents: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_key, bands) of every row; an empty set has no bands."""

    def step(table: pa.Table) -> pa.Table:
        sets = shingle_sets(table["text"])
        keys = np.array([signature(s, bands * rows) for s in sets if len(s)], _U32).reshape(-1, bands, rows).astype(U)
        hashed = np.broadcast_to(np.arange(1, bands + 1, dtype=U), keys.shape[:2]).copy()
        for k in range(rows):
            hashed = mix(hashed * U(0xD6E8FEB86659FD93) + keys[:, :, k])
        full = iter(hashed.view(np.int64))
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "text_hash": table["text_hash"],
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "set_key": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                "bands": pa.array([next(full) if len(s) else [] for s in sets], pa.list_(pa.int64())),
            }
        )

    rows_in = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return map_rows(rows_in, step, "doc_id long, text_hash long, n_shingles long, set_key binary, bands array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """(node, set) of rows (node, text)."""

    def step(table: pa.Table) -> pa.Table:
        sets = [s.view(np.int64) for s in shingle_sets(table["text"])]
        return pa.table({"node": table["node"], "set": pa.array(sets, pa.list_(pa.int64()))})

    return map_rows(texts, step, "node long, set array<long>")


def _open(n_a: Column, own_a: Column, n_b: Column, own_b: Column, percent: int) -> Column:
    """Whether two sets may still reach the threshold: they share at most what neither has for itself."""
    most = F.least(n_a - own_a, n_b - own_b)
    return 100 * most >= percent * (n_a + n_b - most)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    joined = pairs.join(right, "b").join(left, "a")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return joined.filter(100 * shared >= percent * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b")


def links(classes: DataFrame, documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between classes (node, text_hash, n, bands) that connect just what all links together would.

    `documents` gives the texts for the exact comparison.
    """
    members = classes.select("node", "n", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("key")
    buckets = cut(members.join(shared, "key"))
    wanted = buckets.select("node").distinct().join(classes.select("node", "text_hash"), "node")
    texts = (
        documents.select(F.col("doc_id").cast("long").alias("node"), F.xxhash64("text").alias("text_hash"), "text")
        .join(wanted, ["node", "text_hash"])
        .select("node", "text")
    )
    sets = cut(_sets(texts).dropDuplicates(["node"]))
    own = (
        sets.select("node", F.explode("set").alias("shingle"))
        .groupBy("shingle")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("node"))
        .filter("_n = 1")
        .groupBy("node")
        .agg(F.count(F.lit(1)).alias("own"))
    )
    sized = buckets.join(own, "node", "left").fillna(0, ["own"])
    held = cut(sized.filter(100 * (F.col("n") - F.col("own")) >= percent * F.col("n")))

    # Round 1: each bucket's members against its pivot.
    part = (F.col("own") / F.col("n")).alias("part")
    pivots = held.groupBy("key").agg(F.min(F.struct(part, "node", "n", "own")).alias("p"), F.count(F.lit(1)).alias("_n"))
    against = held.join(pivots.filter("_n > 1"), "key").filter(F.col("node") != F.col("p.node"))
    pairs = (
        against.filter(_open(F.col("n"), F.col("own"), F.col("p.n"), F.col("p.own"), percent))
        .select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b"))
        .distinct()
    )
    first = cut(_verified(pairs, sets, percent))

    # Round 2: each bucket's minorities against all of it, by their exact differences from the major component's least member.
    known = components(first)
    placed = cut(
        held.join(known, "node", "left").select(
            "key", "node", "n", "own", F.coalesce("component", "node").alias("component")
        )
    )
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("_n"))
    major = sizes.groupBy("key").agg(F.max(F.struct("_n", "component")).alias("m"), F.count(F.lit(1)).alias("_parts"))
    mixed = placed.join(major.filter("_parts > 1").select("key", F.col("m.component").alias("major")), "key")
    told = cut(mixed.join(_differences(mixed.select("node", "major").distinct(), sets), ["node", "major"]))
    minor, other = told.filter("component <> major"), told.toDF(*(f"_{c}" for c in told.columns))
    apart = (minor["key"] == other["_key"]) & (F.col("component") != F.col("_component"))
    bounds = _open(F.col("n"), F.col("own"), F.col("_n"), F.col("_own"), percent)
    rest = minor.join(other, apart & bounds & _reaches_by_differences(percent))
    return first.unionByName(cut(rest.select(F.col("node").alias("a"), F.col("_node").alias("b")).distinct()))


def _differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of each pair (node, major): the size of major's set, what of it node lacks, and what node has beyond it."""
    reference = sets.select(F.col("node").alias("major"), F.col("set").alias("_whole"))
    return (
        pairs.join(reference, "major")
        .join(sets, "node")
        .select(
            "node",
            "major",
            F.size("_whole").alias("whole"),
            F.array_except("_whole", "set").alias("gone"),
            F.array_except("set", "_whole").alias("came"),
        )
    )


def _reaches_by_differences(percent: int) -> Column:
    """Whether two sets told by their differences from the same third one reach the threshold, exactly."""
    n, many, few = F.col("n") + F.col("_n"), F.size, F.least
    most = F.col("whole") - F.greatest(many("gone"), many("_gone")) + few(many("came"), many("_came"))
    both_gone = many("gone") + many("_gone") - many(F.array_intersect("gone", "_gone"))
    shared = F.col("whole") - both_gone + many(F.array_intersect("came", "_came"))
    return (100 * most >= percent * (n - most)) & (100 * shared >= percent * (n - shared))


def near_duplicates(documents: DataFrame, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least id it is linked to over any path, or its own) and kept."""
    signed = cut(signatures(documents, bands, rows))
    with_id = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    best = F.min(F.struct("doc_id", "text_hash", "bands")).alias("least")
    classes = cut(
        with_id.groupBy("set_key")
        .agg(best, F.max("n_shingles").alias("n"))
        .select("set_key", F.col("least.doc_id").alias("node"), "least.text_hash", "least.bands", "n")
    )
    same_id = with_id.join(classes.select("set_key", "node"), "set_key").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    joined = components(links(classes, documents, percent).unionByName(same_id.filter("a <> b").distinct()))
    return (
        signed.select("doc_id", "n_shingles")
        .join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def without_copies(documents: DataFrame, percent: int = LOOSE) -> DataFrame:
    """`documents` with one row of each group of near-duplicates; rows without an id all stay."""
    kept = near_duplicates(documents.select("doc_id", "text"), percent=percent).filter("kept").select("doc_id").distinct()
    found = documents.filter("doc_id IS NOT NULL").join(kept.withColumnRenamed("doc_id", "_kept"), F.col("doc_id") == F.col("_kept"))
    first = Window.partitionBy("_kept").orderBy(F.xxhash64("text"))
    once = found.withColumn("_row", F.row_number().over(first)).filter("_row = 1").select(*documents.columns)
    return once.unionByName(documents.filter("doc_id IS NULL"))
