"""Ranked lexical search by dense blocked matrix products.

A document's score for an item sums w * impact over the item's distinct terms; w is an integer
per term, the impact an integer per term and document.  Documents are read once and kept as compact postings: only the terms
that some item has, with their counts.  Items are taken in tiles of `TILE_ITEMS`; a tile has its own
compact vocabulary, and its weights (items x terms) times the impacts of a block of documents (terms x documents) are one
BLAS product in float64.  A product spans so few terms that every partial sum stays below 2^53 and is
exact; products are added as 64-bit integers.

Each task keeps the best `nearest` rows per item, equal scores by ascending doc_id, so a block with many ties loses
none that counts; the rest is merged in two levels.  Items go to the tasks in groups of about
`GROUP_BYTES` of terms; each group reads the documents once.

Null and empty texts have no terms and are never found.  Rows of one item_id (null counts as an id) are one
item with the terms of all.  Document rows are told apart even if their doc_id repeats; null ids come behind all others among
equal scores.  Other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm import terms as tm
from tidegraph.llm.base import map_batches, map_rows, stored

NEAREST = 10
TILE_ITEMS = 32
TILE_TERMS = 2_048
BLOCK_DOCUMENTS = 1_024
GROUP_BYTES = 1 << 24
IMPACT = 10**9
MERGES = 64


@dataclass(frozen=True)
class Weighted:
    """Items with their terms as numbers, the weight of each term, and the corpus counts."""

    items: list[int | None]
    terms: list[np.ndarray]
    weights: np.ndarray
    documents: int
    occurrences: int


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) for the distinct terms of each item."""

    def step(rows: pa.Table) -> pa.Table:
        held = [sorted(tm.bag(x, tm.ALPHANUMERIC)) for x in tm.utf8_texts(rows)]
        ids = np.repeat(np.arange(len(held)), [len(x) for x in held])
        return pa.table({"item_id": rows["item_id"].take(pa.array(ids)), "term": pa.array([t for x in held for t in x], pa.binary())})

    rows = items.select(F.col("item_id").cast("long"), "text")
    return map_rows(rows, step, "item_id long, term binary").distinct()


def postings(documents: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """Per document row: doc_id, its number of terms n, and the known ones as `ids` with `counts`."""
    shared = documents.sparkSession.sparkContext.broadcast(numbers)

    def step(rows: pa.Table) -> pa.Table:
        known, n, ids, counts = shared.value, [], [], []
        for text in tm.utf8_texts(rows):
            held = tm.bag(text, tm.ALPHANUMERIC)
            met = held.keys() & known.keys()
            n.append(sum(held.values()))
            ids.append([known[t] for t in met])
            counts.append([held[t] for t in met])
        columns = {"n": pa.array(n, pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32())), "counts": pa.array(counts, pa.list_(pa.int64()))}
        return pa.table({"doc_id": rows["doc_id"], **columns})

    rows = documents.select(F.col("doc_id").cast("long"), "text")
    return map_rows(rows, step, "doc_id long, n long, ids array<int>, counts array<long>")


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Tile:
    """Some items and the terms they have, numbered within the tile and cut into spans that are safe to sum."""

    def __init__(self, all_: Weighted, first: int) -> None:
        self.first = first
        own = all_.terms[first : first + TILE_ITEMS]
        self.vocabulary = np.unique(np.concatenate(own))
        self.size = len(own)
        self.place = np.full(len(all_.weights), -1, np.int64)
        self.place[self.vocabulary] = np.arange(len(self.vocabulary))
        self.row = np.repeat(np.arange(len(own)), [len(x) for x in own])
        self.column = self.place[np.concatenate(own)] if len(self.row) else np.empty(0, np.int64)
        self.weight = all_.weights[self.vocabulary]
        heaviest = int(self.weight.max(initial=1)) or 1
        # An impact is below 10^6, so a span's sums are below span * heaviest * 10^6 < 2^53.
        self.span = max(1, min(TILE_TERMS, (2**53 - 1) // (heaviest * 10**6)))

    def scores(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
        """(items, documents) exact scores of one block."""
        total = np.zeros((self.size, n_docs), np.int64)
        column = self.place[term]
        for low in range(0, len(self.vocabulary), self.span):
            high = min(low + self.span, len(self.vocabulary))
            weights = np.zeros((self.size, high - low))
            here = (self.column >= low) & (self.column < high)
            weights[self.row[here], self.column[here] - low] = self.weight[self.column[here]]
            impacts = np.zeros((high - low, n_docs))
            met = (column >= low) & (column < high)
            impacts[column[met] - low, doc[met]] = impact[met]
            total += (weights @ impacts).astype(np.int64)
        return total


def best_of(scores: np.ndarray, ids: np.ndarray, absent: np.ndarray, nearest: int) -> np.ndarray:
    """Places of the best positive scores, in order; equal ones by id, absent ids last."""
    may = np.flatnonzero(scores > 0)
    if len(may) > nearest:
        bar = np.partition(scores[may], len(may) - nearest)[len(may) - nearest]
        may = may[scores[may] >= bar]  # all that tie at the bar stay until ids are compared
    return may[np.lexsort((ids[may], absent[may], -scores[may]))][:nearest]


def _ranked_part(all_: Weighted, nearest: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tiles = [Tile(all_, k) for k in range(0, len(all_.items), TILE_ITEMS)]
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    best = [none] * len(all_.items)
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_DOCUMENTS):
            rows = batch.slice(at, BLOCK_DOCUMENTS)
            sizes = np.asarray(rows["ids"].value_lengths().fill_null(0))
            doc = np.repeat(np.arange(rows.num_rows), sizes)
            term, counts = np.asarray(rows["ids"].flatten()), np.asarray(rows["counts"].flatten())
            length = 10 + (90 * np.asarray(rows["n"]) * all_.documents) // all_.occurrences
            impact = (IMPACT * counts) // (1000 * counts + 8 * length[doc])
            ids, absent = np.asarray(rows["doc_id"].fill_null(0)), np.asarray(rows["doc_id"].is_null())
            for tile in tiles:
                for k, scores in enumerate(tile.scores(term, doc, impact, rows.num_rows), tile.first):
                    had = best[k]
                    bar = had[0][-1] if len(had[0]) == nearest else 1
                    met = np.flatnonzero(scores >= bar)
                    if len(met):
                        joined = [np.concatenate(x) for x in zip(had, (scores[met], ids[met], absent[met]), strict=True)]
                        kept = best_of(*joined, nearest)
                        best[k] = tuple(x[kept] for x in joined)
    sizes = [len(x[0]) for x in best]
    if sum(sizes):
        score, ids, absent = (np.concatenate([x[part] for x in best]) for part in range(3))
        items = pa.array(all_.items, pa.int64()).take(pa.array(np.repeat(np.arange(len(best)), sizes)))
        yield pa.record_batch({"item_id": items, "doc_id": pa.array(ids, mask=absent), "score": score})


def _group(documents: DataFrame, rows: list, nearest: int) -> DataFrame:
    """The best documents of some items whose terms are `rows`, found per task."""
    spark = documents.sparkSession
    numbers = {t: k for k, t in enumerate(sorted({bytes(r.term) for r in rows}))}
    held: dict[int | None, list[int]] = {}
    for r in rows:
        held.setdefault(r.item_id, []).append(numbers[bytes(r.term)])
    table = stored(postings(documents, numbers))
    n, total = table.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    schema = "item_id long, doc_id long, score long"
    if not total:
        return spark.createDataFrame([], schema)
    counted = table.select(F.explode("ids").alias("id")).groupBy("id").count().collect()  # a row per term of the group
    holding = {r.id: r["count"] for r in counted}
    weights = np.array([weight(n, holding.get(k, 0)) for k in range(len(numbers))], np.int64)
    items = sorted(held, key=lambda x: (x is None, x or 0))
    shared = spark.sparkContext.broadcast(Weighted(items, [np.array(held[x]) for x in items], weights, n, total))
    return map_batches(table.filter(F.size("ids") > 0), lambda batches: _ranked_part(shared.value, nearest, batches), schema)


def rank(documents: DataFrame, items: DataFrame, nearest: int = NEAREST, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of each item."""
    terms = stored(item_terms(items))
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).first()[0]
    groups = max(1, -(-size // group_bytes))
    found = None
    for k in range(groups):
        own = terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == k).collect()  # about GROUP_BYTES
        best = _group(documents, own, nearest)
        found = best if found is None else found.unionByName(best)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    found = found.withColumn("_part", F.spark_partition_id() % MERGES)
    few = F.row_number().over(Window.partitionBy("item_id", "_part").orderBy(*order))
    found = found.withColumn("_few", few).filter(F.col("_few") <= nearest).drop("_few", "_part")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return found.withColumn("rank", place).filter(F.col("rank") <= nearest).select("item_id", "rank", "doc_id", "score")
