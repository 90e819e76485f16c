"""Mixing sources to target weights by Poisson replication.

A source that holds n rows of a total of N and is to make up the share w gets the
mean repetition rate r = w * N / n.  Each row draws its number of copies from the
Poisson distribution with mean r by inverting it at a uniform number hashed from
the seed and the row's id, so that a run repeats exactly and no task needs another's state.  A rate
above `CHUNK` is drawn as a sum of independent parts, because a
Poisson variable is the sum of Poisson variables of parts of its mean.

Copies are dealt to partitions, and ordered within them, by a hash of id and copy
number: a global shuffle without range sampling that no hot source can unbalance.

Weights are relative; a source they do not name gets 0 (no copies), and without
any weights all sources count the same.  Null is a source like any other.  Rows
with equal ids draw equal numbers.  A weight of an absent source is spread over
the others.  An empty table stays empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.lineage import cut

CHUNK = 32.0
SEED = 2026
MAX_BROADCAST_SOURCES = 20_000  # a row is at most about 1 KB; more sources are joined by a shuffle


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the joined parts; a null part is the text "null"."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_table(mean: Column) -> Column:
    """The distribution function of a Poisson variable at 0, 1, 2, ... until it has lost all but 1e-17 or so of its mass."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("upto"))
    grown = F.aggregate(
        F.sequence(F.lit(1), last),
        start,
        lambda a, k: F.struct(
            (a["p"] * mean / k).alias("p"),
            (a["sum"] + a["p"] * mean / k).alias("sum"),
            F.concat(a["upto"], F.array(a["sum"] + a["p"] * mean / k)).alias("upto"),
        ),
    )
    return grown["upto"]


def rates(documents: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """(source, rate, chunks, upto) per source present: its mean repetition rate and the table to invert."""
    counts = documents.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))
    if weights is None:
        weighted = counts.withColumn("weight", F.lit(1.0))
    else:
        if any(w < 0 or not math.isfinite(w) for w in weights.values()):
            raise ValueError("weights are finite and not negative")
        spark = documents.sparkSession
        given = spark.createDataFrame([(k, float(w)) for k, w in weights.items()], "name string, weight double")
        weighted = counts.join(given, F.col("source").eqNullSafe(F.col("name")), "left").select(
            "source", "n_rows", F.coalesce("weight", F.lit(0.0)).alias("weight")
        )
    totals = weighted.agg(F.sum("weight").alias("all_weight"), F.sum("n_rows").alias("all_rows"))
    rate = F.when(
        F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * F.col("all_rows") / F.col("n_rows")
    ).otherwise(0.0)
    return (
        weighted.join(F.broadcast(totals))  # one row
        .withColumn("rate", rate)
        .withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("rate") / CHUNK)).cast("int"))
        .select("source", "rate", "chunks", poisson_table(F.col("rate") / F.col("chunks")).alias("upto"))
    )


def mix(documents: DataFrame, weights: dict[str | None, float] | None = None, seed: int = SEED) -> DataFrame:
    """`documents`, each row as often as drawn, with `_copy` (from 1), `_rate` and `_place`, its key in the global order."""
    columns = documents.columns
    named = cut(rates(documents, weights).withColumnsRenamed({"source": "_source", "rate": "_rate"}))
    if named.count() <= MAX_BROADCAST_SOURCES:
        named = F.broadcast(named)
    draws = F.transform(
        F.sequence(F.lit(1), F.col("chunks")), lambda i: uniform(F.lit(seed), F.col("doc_id"), F.lit("draw"), i)
    )
    copies = F.aggregate(
        draws, F.lit(0), lambda total, u: total + F.size(F.filter(F.col("upto"), lambda p: p <= u)).cast("int")
    )
    counted = documents.join(named, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_copies", copies)
    dealt = (
        counted.filter("_copies > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .withColumn("_place", uniform(F.lit(seed), F.col("doc_id"), F.lit("place"), F.col("_copy")))
        .select(*columns, "_copy", "_rate", "_place")
    )
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartitionById(parts, F.floor(F.col("_place") * parts).cast("int")).sortWithinPartitions(
        "_place", "doc_id", "_copy"
    )
