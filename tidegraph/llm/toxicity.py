"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five weighted transducers are composed; each reads the tape that the one before it writes, and an arc has a weight:

* insult reads an insult of the lexicon as a match, with its learned weight, if the clause has another word;
* threat reads a threatening word as a match, with its learned weight and more shortly after a word of intent;
* target marks matches with a target at most `REACH` words before or after, and adds the target's weight; threats need one;
* negation marks matches at most `REACH` words after a negation and takes its weight off;
* reported speech marks all that follow a reporting word in the clause and takes the word's weight off.

Every match may also be left unread, so a clause has many paths.  Weights along a path add up and the best path counts
(max, plus).  A clause matches if its best path holds a match and weighs more than 0; a word alone is no clause that matches.
A document's evidence is the weight of its matched clauses by mark; it goes through a logistic curve fitted on
labelled rows, with a prior that weakens negated and reported matches until the labels say otherwise.

Insults are learned from labelled rows: whole words, and stems of 4 to 6 letters (`abcd*`) for words that were seen
seldom or never.  The other classes start from small lists; labels give each of their words its weight, down to none.

Clauses end at `.`, `!`, `?`, `;`, `:`, line ends and quotation marks.  A null or empty text holds no clause and gets
the lowest score.  Learning uses at most `MAX_LABELLED` rows,
chosen by a hash of their id; scores cover all rows.  A document with several labels is
toxic if one says so; null labels and null ids teach nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Hashable
from dataclasses import dataclass, field
from functools import cache, cached_property, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.lineage import cut
from tidegraph.llm.base import map_rows, remainder, texts_of
from tidegraph.llm.minhash import signature
from tidegraph.llm.shingles import shingle_sets

MAX_LABELLED = 20_000
MAX_LEXICON = 20_000
MIN_SUPPORT = 3
INSULT_SHARE = 0.95  # how often a text with an insult is toxic
INSULT_PRIOR = 1e-3  # how many words are insults
MAX_WEIGHT = 4.0
REACH = 3
STEMS = (4, 5, 6)
THRESHOLD = 0.3

# Small seed lists of the closed classes; labels weigh their words.
TARGETS = frozenset(
    "you your u he she they them him her it we du dich dir ihr sie er tu toi vous il elle ils tú te usted ustedes él ella".split()
)
NEGATIONS = frozenset("not no never isn't aren't wasn't don't nicht kein keine nie pas jamais ne nunca tampoco".split())
REPORTS = frozenset(
    "said says say wrote writes called calls quoted quote sagte sagt schrieb nannte dit disait écrit dijo dice escribió".split()
)
THREATS = frozenset("kill hurt beat burn die destroy stab shoot töten schlagen tuer frapper matar pegar".split())
INTENTS = frozenset("will shall gonna going werde werden wirst vais allons voy vamos".split())
SEEDS = TARGETS | NEGATIONS | REPORTS | THREATS

INTENT_WEIGHT = 0.5
SEED_ROWS = 4.0  # how many rows at the usual share of toxic ones a seed word is given beforehand
MARKS = ["i", "iy", "in", "ir", "inr", "ty", "tn", "tr", "tnr"]
# Log-odds that a match of each mark adds per unit of evidence, before any label is seen; last, what repetition adds.
PRIOR = np.array([1.0, 1.3, 0.3, 0.5, 0.2, 1.2, 0.2, 0.3, 0.1, 1.0])

_CLAUSE_END = re.compile(r"[.!?;:\n\r\"“”«»]")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


class Symbol(NamedTuple):
    """A word as the tape holds it: what it may be read as, with weights, and once read the kind and marks of the match."""

    insult: float = 0.0
    threat: float = 0.0
    intent: bool = False
    target: float | None = None
    negation: float | None = None
    report: float | None = None
    match: str = ""


State = Hashable
Arc = tuple[State, Symbol, float]


@dataclass(frozen=True)
class Transducer:
    """`arcs(state, symbol)` lists next state, symbol written and weight; a path counts if it ends in a state of `final`."""

    start: State
    arcs: Callable[[State, Symbol], list[Arc]]
    final: Callable[[State], bool]


def insult() -> Transducer:
    """States: at the start, after a word, after a first word read as an insult, which needs another word."""

    def arcs(state: State, x: Symbol) -> list[Arc]:
        plain = [("after", x, 0.0)]
        return plain + [("alone" if state == "start" else "after", x._replace(match="i"), x.insult)] if x.insult > 0 else plain

    return Transducer("start", arcs, lambda state: state != "alone")


def threat(reach: int = REACH) -> Transducer:
    """The state is how many more words a word of intent reaches."""

    def arcs(state: State, x: Symbol) -> list[Arc]:
        then = reach if x.intent else max(0, state - 1)
        read = x.threat > 0 and not x.match
        return [(then, x, 0.0)] + ([(then, x._replace(match="t"), x.threat + (INTENT_WEIGHT if state else 0.0))] if read else [])

    return Transducer(0, arcs, lambda state: True)


def target(reach: int = REACH) -> Transducer:
    """States: free, a target that waits for a match, one that has it, or a match that waits for a target; with the words left."""

    def arcs(state: State, x: Symbol) -> list[Arc]:
        what, left = state
        if what in ("armed", "owed") and left == 0:
            return []
        free, on = ("free", 0), (what, left - 1)
        if x.match:
            marked = x._replace(match=x.match + "y")
            if what == "armed" or (what == "served" and left):
                return [(("served", left - 1), marked, 0.0)]
            if what == "owed":
                return [(on, marked, 0.0)]
            return [(("owed", reach), marked, 0.0)] + ([(free, x, 0.0)] if x.match == "i" else [])
        found = []
        if x.target is not None:
            found = [(("served", reach) if what == "owed" else ("armed", reach), x, x.target)]
            if what in ("armed", "owed"):  # a later target does not release a waiting one
                found = found if what == "owed" else []
        return [(on if what in ("armed", "owed") else on if left > 1 else free, x, 0.0), *found]

    return Transducer(("free", 0), arcs, lambda state: state[0] in ("free", "served"))


def negation(weight: float, reach: int = REACH) -> Transducer:
    """The state is how many more words a negation reaches."""

    def arcs(state: State, x: Symbol) -> list[Arc]:
        if x.match:
            return [(max(0, state - 1), x._replace(match=x.match + "n"), -weight) if state else (0, x, 0.0)]
        return [(reach if x.negation is not None else max(0, state - 1), x, 0.0)]

    return Transducer(0, arcs, lambda state: True)


def reported() -> Transducer:
    """The state is whether the clause has had a reporting word."""

    def arcs(state: State, x: Symbol) -> list[Arc]:
        if x.match:
            return [(state, x._replace(match=x.match + "r") if state else x, 0.0)]
        if x.report is None or state:
            return [(state, x, 0.0)]
        return [(True, x, -x.report)]

    return Transducer(False, arcs, lambda state: True)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that feeds what `first` writes to `second`; weights add up."""

    @cache
    def arcs(state: State, symbol: Symbol) -> list[Arc]:
        return [
            ((a, b), out, v + w)
            for a, middle, v in first.arcs(state[0], symbol)
            for b, out, w in second.arcs(state[1], middle)
        ]

    return Transducer((first.start, second.start), arcs, lambda state: first.final(state[0]) and second.final(state[1]))


def grammar(negation_weight: float) -> list[Transducer]:
    return [insult(), threat(), target(), negation(negation_weight), reported()]


def best_path(machine: Transducer, clause: list[Symbol]) -> tuple[float, list[str]]:
    """Weight and matches of the best path through a clause; among equals, the one listed first."""
    ways: dict[State, tuple[float, tuple | None]] = {machine.start: (0.0, None)}
    for symbol in clause:
        reached: dict[State, tuple[float, tuple | None]] = {}
        for state, (weight, matches) in ways.items():
            for after, out, w in machine.arcs(state, symbol):
                known = reached.get(after)
                if known is None or weight + w > known[0]:
                    reached[after] = (weight + w, (out.match, matches) if out.match else matches)
        ways = reached
    weight, matches = max((way for state, way in ways.items() if machine.final(state)), key=lambda way: way[0])
    found = []
    while matches is not None:
        match, matches = matches
        found.append(match)
    return weight, found[::-1]


def mark(match: str) -> int:
    """The place in MARKS of a written match: negation and report outrank the target."""
    softened = "".join(f for f in "nr" if f in match[1:])
    return MARKS.index(match[0] + (softened or ("y" if "y" in match[1:] else "")))


def forms(words: set[str]) -> set[str]:
    """The words and their stems."""
    return words | {f"{w[:k]}*" for k in STEMS for w in words if len(w) > k}


def insult_weight(word: str, insults: dict[str, float]) -> float | None:
    """The most that the lexicon has for a word or one of its stems."""
    weights = [insults.get(word), *(insults.get(f"{word[:k]}*") for k in STEMS if len(word) > k)]
    return max((w for w in weights if w is not None), default=None)


@dataclass(frozen=True)
class Lexicon:
    """Weights of words by class, and what a negation takes off; the composed grammar is made on first use in a process."""

    insults: dict[str, float]
    threats: dict[str, float] = field(default_factory=lambda: dict.fromkeys(THREATS, 1.0))
    targets: dict[str, float] = field(default_factory=lambda: dict.fromkeys(TARGETS, 0.5))
    reports: dict[str, float] = field(default_factory=lambda: dict.fromkeys(REPORTS, 1.0))
    negation: float = 1.0

    @cached_property
    def machine(self) -> Transducer:
        return reduce(compose, grammar(self.negation))

    def symbol(self, word: str) -> Symbol:
        return Symbol(
            round(insult_weight(word, self.insults) or 0.0, 1),
            round(self.threats.get(word, 0.0), 1),
            word in INTENTS,
            self.targets.get(word),
            self.negation if word in NEGATIONS else None,
            self.reports.get(word),
        )

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "machine"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)


def evidence(text: str, lexicon: Lexicon) -> np.ndarray | None:
    """Log of 1 + the summed weight of matched clauses per mark, log of the number of matches, number of clauses; None without one."""
    text = text.lower()
    words, insults, threats = set(_WORD.findall(text)), lexicon.insults, lexicon.threats
    telling = {w for w in words if threats.get(w) or insult_weight(w, insults) is not None}
    if not telling:
        return None
    symbols: dict[str, Symbol] = {}
    sums, matches, clauses = np.zeros(len(MARKS)), 0, 0
    for clause in _CLAUSE_END.split(text):
        words = _WORD.findall(clause)
        if telling.isdisjoint(words):
            continue
        symbols |= {w: lexicon.symbol(w) for w in set(words) - symbols.keys()}
        weight, found = best_path(lexicon.machine, [symbols[w] for w in words])
        if found and weight > 0:
            for match in found:
                sums[mark(match)] += weight / len(found)
            matches, clauses = matches + len(found), clauses + 1
    return np.concatenate([np.log1p(sums), [np.log(matches), clauses]]) if matches else None


def _labelled(documents: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, toxic) of at most about `max_rows` labelled rows that may teach, chosen by a hash of the id.

    Copies and near copies would make their chance words look like insults, so of texts with
    the same least shingle only the one with the least id teaches.
    """
    toxic = (
        labels.select(F.col("doc_id").alias("_labelled"), F.col("toxic").cast("int").alias("toxic"))
        .filter("toxic IS NOT NULL AND _labelled IS NOT NULL")
        .filter(remainder("_labelled", 4) != 2)
        .groupBy("_labelled")
        .agg(F.max("toxic").alias("toxic"))
    )
    share = min(1.0, max_rows / max(1, toxic.count()))
    chosen = toxic.filter(F.pmod(F.xxhash64("_labelled"), F.lit(1 << 20)) < int(share * (1 << 20)))
    labelled = cut(
        documents.select("doc_id", "text")
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("_labelled"))
        .select(F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic")
    )

    def step(rows: pa.Table) -> pa.Table:
        least = [int(signature(s, 1)[0]) if len(s) else -1 for s in shingle_sets(rows["text"])]
        return pa.table({"doc_id": rows["doc_id"], "toxic": rows["toxic"], "key": pa.array(least, pa.int64())})

    keyed = map_rows(labelled, step, "doc_id long, toxic int, key long")
    once = keyed.groupBy("key", "toxic").agg(F.min("doc_id").alias("_once")).select("_once").distinct()
    return labelled.join(F.broadcast(once), F.col("doc_id") == F.col("_once")).select("text", "toxic")


def learn_lexicon(labelled: DataFrame) -> Lexicon:
    """Words and stems that mark toxic texts, weighted by the log-odds that they are insults, and weights of the seed words.

    The odds compare how well the texts that hold the word fit an insult, toxic at the rate
    `INSULT_SHARE`, and any other word, toxic at the rate of all texts.  A seed word's weight moves by how
    much more, or less, its texts are toxic than others.
    """

    def step(rows: pa.Table) -> pa.Table:
        seen: dict[str, Counter] = {"0": Counter(), "1": Counter()}
        for text, toxic in zip(texts_of(rows), rows["toxic"].to_pylist(), strict=True):
            seen[str(int(toxic > 0))].update(forms(set(_WORD.findall(text.lower()))))
        words = list(seen["0"].keys() | seen["1"].keys())
        return pa.table(
            {
                "word": pa.array(words, pa.string()),
                "bad": pa.array([seen["1"][w] for w in words], pa.int64()),
                "good": pa.array([seen["0"][w] for w in words], pa.int64()),
            }
        )

    share = labelled.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    share = min(0.5, max(0.01, share or 0.0))
    fit = F.col("bad") * float(np.log(INSULT_SHARE / share)) + F.col("good") * float(np.log((1 - INSULT_SHARE) / (1 - share)))
    seed = F.col("word").isin(sorted(SEEDS))
    best = (
        map_rows(labelled, step, "word string, bad long, good long")
        .groupBy("word")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .select("word", "bad", "good", (fit + float(np.log(INSULT_PRIOR))).alias("odds"), seed.alias("seed"))
        .filter(F.col("seed") | ((F.col("bad") >= MIN_SUPPORT) & (F.col("odds") > 0)))
        .orderBy(F.desc("seed"), F.desc("odds"), "word")
        .limit(MAX_LEXICON + len(SEEDS))  # the documented size of the model
    )
    rows = best.collect()
    usual = np.log(share / (1 - share))
    lean = {
        r.word: float(np.log((r.bad + SEED_ROWS * share) / (r.good + SEED_ROWS * (1 - share))) - usual) for r in rows if r.seed
    }

    def weigh(words: frozenset[str], base: float, sign: int, most: float) -> dict[str, float]:
        return {w: round(float(np.clip(base + sign * lean.get(w, 0.0), 0.0, most)), 1) for w in sorted(words)}

    return Lexicon(
        {r.word: min(r.odds, MAX_WEIGHT) for r in rows if not r.seed},
        weigh(THREATS, 1.0, 1, MAX_WEIGHT),
        weigh(TARGETS, 0.5, 1, 1.0),
        weigh(REPORTS, 1.0, -1, MAX_WEIGHT / 2),
        float(np.mean(list(weigh(NEGATIONS, 1.0, -1, MAX_WEIGHT / 2).values()))),
    )


def fit_curve(features: np.ndarray, toxic: np.ndarray, rounds: int = 30, strength: float = 1.0) -> np.ndarray:
    """Logistic weights (last: the intercept) by Newton steps, drawn to the prior with `strength`."""
    x = np.hstack([features, np.ones((len(features), 1))])
    prior = np.append(PRIOR, -3.0)
    w, ridge = prior.copy(), np.full(len(prior), strength)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (toxic - p) - ridge * (w - prior)
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(bend, slope)
        w = w + move * min(1.0, 2.0 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: np.ndarray


def learn(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> Model:
    """Lexicon and curve from labelled rows; at most `max_rows` small feature rows reach the driver."""
    labelled = _labelled(documents, labels, max_rows)
    lexicon = learn_lexicon(labelled)

    def step(rows: pa.Table) -> pa.Table:
        kept = Counter()
        for text, toxic in zip(texts_of(rows), rows["toxic"].to_pylist(), strict=True):
            found = evidence(text, lexicon)
            kept[(tuple(np.zeros(len(PRIOR))) if found is None else tuple(found[:-1].round(2)), int(toxic > 0))] += 1
        return pa.table(
            {
                "features": pa.array([list(f) for f, _ in kept], pa.list_(pa.float64())),
                "toxic": pa.array([t for _, t in kept], pa.int32()),
                "n": pa.array(list(kept.values()), pa.int64()),
            }
        )

    rows = (
        map_rows(labelled, step, "features array<double>, toxic int, n long")
        .groupBy("features", "toxic")
        .agg(F.sum("n").alias("n"))
        .orderBy("features", "toxic")
        .collect()
    )
    if not rows:
        return Model(lexicon, np.append(PRIOR, -3.0))
    counts = [r.n for r in rows]
    features = np.repeat([r.features for r in rows], counts, axis=0)
    return Model(lexicon, fit_curve(features, np.repeat([r.toxic for r in rows], counts).astype(float)))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, and the number of matched clauses."""
    lexicon, weights = model.lexicon, model.weights

    def step(rows: pa.Table) -> pa.Table:
        scores, clauses = _scores(texts_of(rows), lexicon, weights)
        return pa.table(
            {
                "doc_id": rows["doc_id"],
                "held_out": rows["held_out"],
                "score": scores,
                "predicted": (scores >= THRESHOLD).astype(np.int32),
                "n_clauses": clauses,
            }
        )

    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    schema = "doc_id long, held_out boolean, score double, predicted int, n_clauses long"
    return map_rows(documents.select(F.col("doc_id").cast("long"), held_out, "text"), step, schema)


def _scores(texts: list[str], lexicon: Lexicon, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    logits, clauses = np.full(len(texts), weights[-1]), np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        found = evidence(text, lexicon)
        if found is not None:
            logits[k] += found[:-1] @ weights[:-1]
            clauses[k] = found[-1]
    return 1 / (1 + np.exp(-np.clip(logits, -30, 30))), clauses


def without_toxic(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of `documents` whose score stays below the threshold, unchanged."""
    lexicon, weights = model.lexicon, model.weights

    def step(rows: pa.Table) -> pa.Table:
        return rows.filter(pa.array(_scores(texts_of(rows), lexicon, weights)[0] < THRESHOLD))

    return map_rows(documents, step, documents.schema)
