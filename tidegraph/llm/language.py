"""Language identification by words first, then shorter and shorter character n-grams.

A word that the model knows adds its log frequency per language.  An unknown word is
read character by character: at each, the longest known n-gram that ends there, from `ORDERS` characters
down to one, gives its log frequency less a penalty per step of backing off; their mean counts as
one word.  N-grams lie inside a word and the separator before it.

The model is learned from texts with a language whose crc32(doc_id) modulo 5 is not
0: at most about `MAX_PER_LANGUAGE` texts per language, chosen by a hash of the id, read whole;
`MAX_ENTRIES` words and n-grams of each order, shared among the languages, reach the driver.

A letter is what `str.isalpha` says; words are runs of letters in lower case.  Texts that are null or have no letter are
`und` with score 0, and so is every text if nothing could be learned.  The score is the softmax of
the best language over the mean of at most 20 words.  Ties go to the first language by name.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm import shingles as sh
from tidegraph.llm.base import map_rows, remainder, texts_of

ORDERS = 5
MAX_PER_LANGUAGE = 4_000
MAX_ENTRIES = 400_000
BACKOFF = float(np.log(0.4))
SMOOTH = 0.5
SEPARATOR = 32
CHUNK_CHARS = 1 << 21


@cache
def _unicode() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: the letter in lower case, or the separator; and its random 64-bit value."""
    lower = np.full(0x110000, SEPARATOR, np.uint32)
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            small = c.lower()
            lower[k] = ord(small) if len(small) == 1 else k
    return lower, sh.mix(np.arange(1, 0x110001, dtype=sh.U))


class Letters:
    """The letters of some texts, a separator around each text, with running hashes."""

    def __init__(self, texts: list[str]) -> None:
        lower, value = _unicode()
        parts = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in texts]
        ends = np.cumsum([len(p) + 1 for p in parts])
        chars = np.full(int(ends[-1]) + 1 if parts else 1, SEPARATOR, np.uint32)
        for p, end in zip(parts, ends, strict=True):
            chars[end - len(p) : end] = lower[p]
        self.chars = chars
        self.sums = np.empty(len(chars) + 1, sh.U)
        self.sums[0] = 0
        np.cumsum(value[chars] * sh.powers(sh.BASE, len(chars)), out=self.sums[1:])
        letter = chars != SEPARATOR
        self.starts = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
        self.ends = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
        self.first = np.searchsorted(self.starts, np.append(0, ends))  # the first word of each text, and one past the last

    def words(self) -> np.ndarray:
        return sh.span_hashes(self.sums, self.starts, self.ends)

    def positions(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every character of the chosen words: its place, its word (counted among the chosen), its place in the word from 1."""
        starts, sizes = self.starts[chosen], self.ends[chosen] - self.starts[chosen]
        word = np.repeat(np.arange(len(starts)), sizes)
        within = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return starts[word] + within, word, within + 1

    def grams(self, places: np.ndarray, order: int) -> np.ndarray:
        """The hash of the n-gram that ends at each place."""
        return sh.span_hashes(self.sums, places - order + 1, places + 1)


class Model:
    """Languages by name, and per order (0: words) the hashes and log frequencies."""

    def __init__(self, languages: list[str], hashes: list[np.ndarray], logs: list[np.ndarray], floor: float) -> None:
        self.languages, self.hashes, self.logs, self.floor = languages, hashes, logs, floor

    @property
    def tables(self) -> list[sh.Table]:
        if "_tables" not in self.__dict__:
            self._tables = [sh.Table(h) for h in self.hashes]
        return self._tables

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_tables"}

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The log frequency per text and language, averaged over its words, and the number of words."""
        letters = Letters(texts)
        n = np.diff(letters.first)
        if not len(letters.starts):
            return np.zeros((len(texts), len(self.languages))), n
        rows = self.tables[0].find(letters.words())
        values = self.logs[0][rows]
        unknown = np.flatnonzero(rows < 0)
        if len(unknown):
            values[unknown] = self._by_grams(letters, unknown)
        sums = np.vstack([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)])
        totals = sums[letters.first[1:]] - sums[letters.first[:-1]]
        return totals / np.maximum(n, 1)[:, None], n

    def _by_grams(self, letters: Letters, unknown: np.ndarray) -> np.ndarray:
        places, word, within = letters.positions(unknown)
        out = np.full((len(places), len(self.languages)), self.floor + ORDERS * BACKOFF, np.float32)
        left = np.arange(len(places))
        for order in range(ORDERS, 0, -1):
            fits = left if order <= 2 else left[within[left] >= order - 1]
            rows = self.tables[order].find(letters.grams(places[fits], order))
            known = rows >= 0
            out[fits[known]] = self.logs[order][rows[known]] + (ORDERS - order) * BACKOFF
            done = np.zeros(len(places), bool)
            done[fits[known]] = True
            left = left[~done[left]]
        starts = np.flatnonzero(within == 1)
        return np.add.reduceat(out, starts, axis=0) / np.diff(np.append(starts, len(places)))[:, None]


def _slices(texts: list[str]) -> list[tuple[int, int]]:
    return sh.chunks(np.append(0, np.cumsum([len(x) for x in texts])), CHUNK_CHARS)


def _training_rows(documents: DataFrame) -> DataFrame:
    may = documents.select("doc_id", F.col("lang").alias("language"), "text").filter(
        "language IS NOT NULL AND text IS NOT NULL"
    )
    may = may.filter(remainder("doc_id", 5) != 0)
    counts = may.groupBy("language").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per language
    share = F.create_map(*(F.lit(x) for r in counts for x in (r.language, min(1.0, MAX_PER_LANGUAGE / r.n)))) if counts else None
    if share is None:
        return may.select("language", "text")
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("language")] * (1 << 20)
    return may.filter(chosen).select("language", "text")


def _counted(rows: DataFrame) -> DataFrame:
    """(language, place, hash, n): how often a text of the language holds each word (place 0) and n-gram of `place` characters."""

    def step(table: pa.Table) -> pa.Table:
        texts, names = texts_of(table), np.array(table["language"].to_pylist(), object)
        out: dict[str, list] = {"language": [], "place": [], "hash": [], "n": []}
        for name in sorted(set(names)):
            letters = Letters([t for t, x in zip(texts, names, strict=True) if x == name])
            places, _, within = letters.positions(np.arange(len(letters.starts)))
            for order in range(ORDERS + 1):
                found = letters.words() if order == 0 else letters.grams(places[within >= order - 1], order)
                hashes, n = np.unique(found, return_counts=True)
                out["language"].append(pa.array([name] * len(n), pa.string()))
                out["place"].append(pa.array(np.full(len(n), order, np.int32)))
                out["hash"].append(pa.array(hashes.view(np.int64)))
                out["n"].append(pa.array(n.astype(np.int64)))
        return pa.table({k: pa.chunked_array(v) for k, v in out.items()})

    return map_rows(rows, step, "language string, place int, hash long, n long").groupBy("language", "place", "hash").agg(
        F.sum("n").alias("n")
    )


def learn(documents: DataFrame) -> Model:
    """A model of bounded size from a bounded sample of the texts that may teach."""
    counted = _counted(_training_rows(documents)).cache()
    totals = counted.groupBy("language", "place").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).collect()
    languages = sorted({r.language for r in totals})
    if not languages:
        counted.unpersist()
        return Model([], [], [], 0.0)
    most = max(100, MAX_ENTRIES // (len(languages) * (ORDERS + 1)))
    rank = F.row_number().over(Window.partitionBy("language", "place").orderBy(F.desc("n"), "hash"))
    kept = counted.filter("n > 1 OR place BETWEEN 1 AND 2").withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")
    rows = kept.toPandas()
    counted.unpersist()
    total = {(r.language, r.place): (r.total, r.kinds) for r in totals}
    number = {x: k for k, x in enumerate(languages)}
    hashes, logs, floor = [], [], 0.0
    for place in range(ORDERS + 1):
        own = rows[rows.place == place]
        known, at = np.unique(own.hash.to_numpy(np.int64).view(np.uint64), return_inverse=True)
        counts = np.full((len(known), len(languages)), SMOOTH)
        counts[at, own.language.map(number).to_numpy(np.int64)] += own.n.to_numpy()
        sizes = np.array([sum(total.get((x, place), (0, 0)) * np.array([1, SMOOTH])) + 1 for x in languages])
        hashes.append(known)
        logs.append(np.log(counts / sizes).astype(np.float32))
        floor = min(floor, float(np.log(SMOOTH / sizes.max())))
    return Model(languages, hashes, logs, floor)


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most MAX_ENTRIES entries

    def step(rows: pa.Table) -> pa.Table:
        model, texts = shared.value, texts_of(rows)
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        for a, b in _slices(texts) if model.languages else []:
            means, n = model.score(texts[a:b])
            logits = means * np.minimum(n, 20)[:, None]
            best = logits.argmax(axis=1)
            top = 1 / np.exp(logits - logits.max(axis=1, keepdims=True)).sum(axis=1)
            for k in np.flatnonzero(n):
                names[a + k], scores[a + k] = model.languages[best[k]], min(1.0, top[k])
        return pa.table({"doc_id": rows["doc_id"], "held_out": rows["held_out"], "lang_pred": names, "score": scores})

    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    rows = documents.select(F.col("doc_id").cast("long"), held_out, "text")
    return map_rows(rows, step, "doc_id long, held_out boolean, lang_pred string, score double")
