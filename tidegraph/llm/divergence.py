"""How far the sources of a language are from each other and from the language, by exact term shares.

Per language a vocabulary is built as by a count vectorizer with a least document frequency
and no other bound (`VOCABULARY_SIZE` is the largest integer): terms are numbered from 1 by falling document frequency.
Every document becomes an exact sparse vector of counts; vectors are summed per (lang, source), first in the tasks.  The
vocabulary never passes through one task: it is a table, and its blocks of at most about
`BLOCK_BYTES` go to the tasks in turn, each with a pass over the documents of its languages.

A group gives a term the share p = 1 + (10^9 * (count + 5)) div (N + 5 * V), N being the sum of its counts and V the size
of the vocabulary; a term that it lacks has the base share b.  Pairs of sources are evaluated from the sparse sums.  For sources
g and h, only terms that one of them holds are looked at; the others differ by |b_g - b_h| each.  Sources are hashed into blocks of about
`SOURCE_BLOCK`, terms into buckets of about `TERM_BUCKET`; a task gets two blocks of one bucket.

Null text, lang and source count as ''.  Repeated rows count as often as they come; doc_id and other columns are not read.
Groups without terms take part with N = 0; where V = 0 all pairs have value 0 and there are no term rows.  Equal values
are ranked by the item in UTF-8 order.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm import terms as tm
from tidegraph.llm.base import BATCH_ROWS, find_package, map_batches, stored
from tidegraph.operators.ordering import running_count

MIN_DOCUMENTS = 30
VOCABULARY_SIZE = 2**31 - 1
SMOOTH = 5
SCALE = 10**9
TOP_TERMS = 50
BLOCK_BYTES = 1 << 27
TERM_BYTES = 100
HELD_TERMS = 150_000
SENT_ROWS = 1 << 14
HELD_ENTRIES = 1 << 21
SOURCE_BLOCK = 64
TERM_BUCKET = 2_048
GROUP = ["lang", "source"]


def grouped(documents: DataFrame) -> DataFrame:
    """(lang, source, text) without nulls."""
    return documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in [*GROUP, "text"]))


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Table]]:
    """The rows of at most `BATCH_ROWS` neighbours, language by language."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            rows = pa.Table.from_batches([batch.slice(at, BATCH_ROWS)])
            langs = rows["lang"].combine_chunks().dictionary_encode()
            order = np.argsort(np.asarray(langs.indices), kind="stable")
            ends = np.append(0, np.cumsum(np.bincount(np.asarray(langs.indices), minlength=len(langs.dictionary))))
            rows = rows.take(pa.array(order))
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                yield lang, rows.slice(ends[k], ends[k + 1] - ends[k])


def document_frequencies(documents: DataFrame) -> DataFrame:
    """(lang, term, df): how many documents of a language hold each term; summed up in the tasks first."""

    def summed(parts: list[pa.Table]) -> pa.Table:
        if len(parts) == 1:
            return parts[0]
        both = pa.concat_tables(parts).group_by("term", use_threads=False).aggregate([("df", "sum")])
        return pa.table({"term": both["term"], "df": both["df_sum"]})

    def emit(held: dict[str, list[pa.Table]]) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            total = summed(parts)
            named = pa.repeat(pa.scalar(lang, pa.string()), len(total))
            rows = pa.table({"lang": named, "term": total["term"].cast(pa.binary()), "df": total["df"]})
            yield from rows.to_batches(max_chunksize=SENT_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Table]] = {}
        size = 0
        for lang, rows in _by_lang(batches):
            for terms, _, index, _ in tm.vectors(tm.utf8_texts(rows), tm.LETTERS, lambda terms: np.arange(len(terms))):
                counts = np.bincount(index, minlength=len(terms))
                held.setdefault(lang, []).append(pa.table({"term": terms, "df": pa.array(counts, pa.int64())}))
                size += len(terms)
                if size > HELD_TERMS:
                    held = {k: [summed(parts)] for k, parts in held.items()}
                    size = sum(len(parts[0]) for parts in held.values())
                if size > HELD_TERMS:
                    yield from emit(held)
                    held, size = {}, 0
        yield from emit(held)

    counts = map_batches(documents.select("lang", "text"), run, "lang string, term binary, df long")
    return counts.groupBy("lang", "term").agg(F.sum("df").alias("df"))


def vocabulary(documents: DataFrame, least: int = MIN_DOCUMENTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, index, term, df, block): the kept terms of each language, numbered from 1 by falling frequency."""
    kept = document_frequencies(documents).filter(F.col("df") >= least).withColumn("_less", -F.col("df"))
    numbered = running_count(kept, ["lang"], ["_less", "term"], F.lit(1), "index").filter(F.col("index") <= VOCABULARY_SIZE)
    sized = running_count(numbered.withColumn("_one", F.lit(0)), ["_one"], ["lang", "index"], F.octet_length("term") + TERM_BYTES, "_upto")
    block = F.expr(f"(_upto - 1) div {block_bytes}").alias("block")
    return stored(sized.select("lang", F.col("index").cast("int").alias("index"), "term", "df", block))


def _own(documents: DataFrame, block: list) -> tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]:
    """The documents in the languages of a block of the vocabulary, and what makes a sparse vector of each."""
    held: dict[str, dict[bytes, int]] = {}
    for r in block:
        held.setdefault(r.lang, {})[bytes(r.term)] = r["index"]
    shared = documents.sparkSession.sparkContext.broadcast(held)  # about BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for lang, rows in _by_lang(batches):
            find = known[lang].get

            def number(terms: pa.Array, find: Callable = find) -> np.ndarray:
                return np.fromiter((find(t, -1) for t in terms.to_pylist()), np.int64, len(terms))

            parts = [part[1:] for part in tm.vectors(tm.utf8_texts(rows), tm.LETTERS, number)]
            text, index, count = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*parts, strict=True) if parts else [()] * 3))
            ends = pa.array(np.append(0, np.cumsum(np.bincount(text, minlength=len(rows)))), pa.int32())
            vector = {
                "indices": pa.ListArray.from_arrays(ends, pa.array(index, pa.int32())),
                "counts": pa.ListArray.from_arrays(ends, pa.array(count, pa.int64())),
            }
            yield from pa.table({"lang": rows["lang"], "source": rows["source"], **vector}).to_batches()

    return documents.filter(F.col("lang").isin(list(held))), run


def vectors(documents: DataFrame, block: list) -> DataFrame:
    """(lang, source, indices, counts): per row the sparse vector over the terms of one block of the vocabulary."""
    own, run = _own(documents, block)
    return map_batches(own, run, "lang string, source string, indices array<int>, counts array<long>")


def vector_sums(documents: DataFrame, block: list) -> DataFrame:
    """(lang, source, index, count): the sum of the `vectors` of each group, zeros left out; taken where they are made."""

    def emit(held: dict[tuple[str, str], list]) -> Iterator[pa.RecordBatch]:
        for (lang, source), parts in held.items():
            entries = pa.table({"index": np.concatenate([x for x, _ in parts]), "count": np.concatenate([n for _, n in parts])})
            sums = entries.group_by("index", use_threads=False).aggregate([("count", "sum")])
            names = {k: pa.repeat(pa.scalar(x, pa.string()), len(sums)) for k, x in (("lang", lang), ("source", source))}
            yield from pa.table({**names, "index": sums["index"], "count": sums["count_sum"]}).to_batches()

    own, made = _own(documents, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list] = {}
        entries = 0
        for batch in made(batches):
            ends = np.append(0, np.cumsum(batch["indices"].value_lengths()))
            indices, counts = np.asarray(batch["indices"].flatten()), np.asarray(batch["counts"].flatten())
            for k, group in enumerate(zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), strict=True)):
                span = slice(ends[k], ends[k + 1])
                if span.start < span.stop:
                    held.setdefault(group, []).append((indices[span].copy(), counts[span].copy()))
            entries += len(indices)
            if entries > HELD_ENTRIES:
                yield from emit(held)
                held, entries = {}, 0
        yield from emit(held)

    partial = map_batches(own, run, "lang string, source string, index int, count long")
    return partial.groupBy(*GROUP, "index").agg(F.sum("count").alias("count"))


def group_sums(documents: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, source, index, count) over the whole vocabulary, block by block."""
    blocks = words.agg(F.coalesce(F.max("block") + 1, F.lit(1))).first()[0]
    sums = None
    for k in range(blocks):
        block = words.filter(F.col("block") == k).select("lang", "term", "index").collect()  # about BLOCK_BYTES
        part = vector_sums(documents, block)
        sums = part if sums is None else sums.unionByName(part)
    return stored(sums)


def share(count: Column, total: Column, size: Column) -> Column:
    """1 + (10^9 * (count + 5)) div (N + 5 * V) in exact decimals."""
    wide = (F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(19,0)")).alias("wide")
    return F.lit(1) + F.call_function("div", wide, (total + F.lit(SMOOTH) * size).cast("decimal(19,0)"))


def _pair_tile(rows: pa.Table) -> pa.Table:
    """Partial values of all pairs between two blocks of sources, over the terms of one bucket."""
    blocks = rows["low"][0].as_py(), rows["high"][0].as_py()
    names = rows["source"].combine_chunks().dictionary_encode()
    named, source = names.dictionary.to_pylist(), np.asarray(names.indices)
    own, p = np.asarray(rows["own"]), np.asarray(rows["p"])
    terms, term = np.unique(np.asarray(rows["index"]), return_inverse=True)
    base, side = np.zeros(len(named), np.int64), np.zeros(len(named), np.int64)
    base[source], side[source] = np.asarray(rows["base"]), own
    entry = np.asarray(rows["index"]) > 0  # the others only tell that a source is there
    source, own, p, term = source[entry], own[entry], p[entry], term[entry]
    order = np.argsort(source, kind="stable")
    ends = np.searchsorted(source[order], np.arange(len(named) + 1))
    right = np.flatnonzero(own == blocks[1])
    h, ht, hp = source[right], term[right], p[right]
    size = np.bincount(source, minlength=len(named))
    out: list[tuple[np.ndarray, ...]] = []
    for g in np.flatnonzero(side == blocks[0]):
        mine = order[ends[g] : ends[g + 1]]
        dense = np.zeros(len(terms), np.int64)
        dense[term[mine]] = p[mine]
        met = dense[ht]
        both = met > 0
        sums = np.bincount(h, np.abs(hp - np.where(both, met, base[g])), len(named))
        sums -= np.bincount(h[both], np.abs(met[both] - base[h[both]]), len(named))
        union = size[g] + size - np.bincount(h[both], minlength=len(named))
        to = np.flatnonzero((side == blocks[1]) & ((blocks[0] < blocks[1]) | (np.arange(len(named)) > g)))
        alone = np.abs(p[mine][:, None] - base[to][None, :]).sum(axis=0)
        out.append((np.full(len(to), g), to, sums[to].astype(np.int64) + alone, union[to]))
    a, b, value, union = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 4
    label = pa.array(named, pa.string())
    lang = pa.array([rows["lang"][0].as_py()] * len(a), pa.string())
    return pa.table({"lang": lang, "a": label.take(pa.array(a)), "b": label.take(pa.array(b)), "part": pa.array(value), "held": pa.array(union)})


def _others() -> Column:
    return F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))


def pair_values(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the summed difference of shares for all ordered pairs of sources of a language.

    `groups` is (lang, source, size, base, own, blocks) with `size` the vocabulary's; `shares` adds (index, p).
    """
    buckets = F.greatest(F.lit(1), F.ceil(F.col("size") / TERM_BUCKET))
    own = ["lang", "source", "own", "blocks", "base"]
    entries = shares.select(*own, "index", "p", F.pmod("index", buckets).alias("bucket"))
    # A source without terms in a bucket differs there from all that have some, so each is named in every bucket.
    there = groups.select(*own, F.lit(0).alias("index"), F.lit(0).cast("long").alias("p"), F.explode(F.sequence(F.lit(0), buckets - 1)).alias("bucket"))
    dealt = (
        entries.unionByName(there).select("*", _others().alias("_other"))
        .withColumn("low", F.least("own", "_other"))
        .withColumn("high", F.greatest("own", "_other"))
        .select("lang", "low", "high", "bucket", "source", "own", "index", "p", "base")
    )
    tiles = dealt.groupBy("lang", "low", "high", "bucket").applyInArrow(_pair_tile, "lang string, a string, b string, part long, held long")
    once = tiles.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("part").alias("part"), F.sum("held").alias("held"))
    one, two = F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))
    summed = once.select("lang", F.explode(F.array(one, two)).alias("_pair"), "part", "held").select("lang", "_pair.*", "part", "held")
    left = groups.select("lang", "source", "size", "base", F.col("own").alias("_x"), _others().alias("_y"))
    right = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("_base"), F.col("own").alias("_y"), _others().alias("_x"))
    pairs = left.join(right, ["lang", "_x", "_y"]).filter("source <> item").join(summed, ["lang", "source", "item"], "left")
    rest = (F.col("size") - F.coalesce("held", F.lit(0))) * F.abs(F.col("base") - F.col("_base"))
    value = F.coalesce("part", F.lit(0)) + rest
    return pairs.select(*GROUP, "item", F.when(F.col("size") == 0, F.lit(0)).otherwise(value).cast("long").alias("value"))


def audit(documents: DataFrame, least: int = MIN_DOCUMENTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group and its parts `pair` and `term`."""
    rows = grouped(documents)
    words = vocabulary(rows, least, block_bytes)
    sums = group_sums(rows, words)
    find_package(documents.sparkSession)
    size = words.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    totals = sums.groupBy(*GROUP).agg(F.sum("count").alias("total"))
    groups = rows.select(*GROUP).distinct().join(totals, GROUP, "left").join(size, "lang", "left").fillna(0, ["total", "size"])
    sources = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SOURCE_BLOCK).alias("blocks"))
    base = F.when(F.col("size") > 0, share(F.lit(0), F.col("total"), F.col("size"))).otherwise(F.lit(0))
    groups = groups.join(sources, "lang").withColumn("base", base.cast("long"))
    groups = stored(groups.withColumn("own", F.pmod(F.xxhash64("source"), "blocks")))
    shares = sums.join(groups, GROUP).withColumn("p", share(F.col("count"), F.col("total"), F.col("size")).cast("long"))

    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("_all"))
    whole = sums.groupBy("lang", "index").agg(F.sum("count").alias("_in_lang")).join(of_lang, "lang")
    whole = whole.join(words.select("lang", "index", F.decode("term", "UTF-8").alias("item")), ["lang", "index"])
    q = share(F.col("_in_lang"), F.col("_all"), F.col("size")).cast("long")
    above = shares.join(whole, ["lang", "index"]).withColumn("value", F.col("p") - q).filter("value > 0")
    by = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    top = above.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= TOP_TERMS)
    pairs = pair_values(shares, groups).withColumn("rank", F.row_number().over(by))
    both = [
        df.select(*GROUP, F.lit(part).alias("part"), "item", "value", "rank") for df, part in ((pairs, "pair"), (top, "term"))
    ]
    return both[0].unionByName(both[1])
