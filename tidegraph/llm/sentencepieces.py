"""SentencePiece encoding with exact N-best segmentations, and decoding.

A text is a lattice of vocabulary pieces.  A forward Viterbi pass gives the best score up to each place;
those scores are exact heuristics for an A-star search backwards from the end, which
pops whole segmentations in order of their score.

No piece runs from a non-space into a space, so a text falls into segments whose
lattices touch at single places only.  Its best segmentation joins those of the segments, and its N best
differ from it in the N - 1 segments that lose least at most: only there the A-star search runs, and the sums are merged.
Every distinct segment is solved once per worker, within a bounded cache.

A path score is the sum of its pieces' log-probabilities.  A unigram model's file holds them.  A BPE model's file holds ranks of
merges, all of them whole numbers, which mean nothing when added; there the piece of rank r gets the Zipf-Mandelbrot estimate
log(1 / (r + 2.7)) less the log of the sum over all pieces.  That is not the merging of a BPE encoder: the library's
encoding of such a model is one path of the lattice, and over a whole text seldom the very best one.  Scores are rounded to multiples of 2^-20, so sums are exact.

Spaces become U+2581 with one in front; a character without a piece falls back to
the pieces of its UTF-8 bytes, at the least piece score less 10 per character.  Of equal scores,
the one with the longer last piece comes first, and in a text the one that deviates earlier.
Decoding gives the text back exactly, but for a U+2581 in it, which becomes a space.

A null or empty text has one segmentation, without pieces, of score 0.  Repeated
rows each get their own result.  Vocabularies are read from a file and never trained.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm import shingles as sh
from tidegraph.llm.base import map_rows, texts_of
from tidegraph.llm.shingles import Table

SPACE = "▁"
N_BEST = 4
CACHED_CHARS = 12_000_000
SHORT = 64
SOLVED_CHARS = 60_000
UNKNOWN_PENALTY = 10.0
ZIPF_SHIFT = 2.7
SCORE_STEP = 2.0**-20
_NEVER = float("-inf")
_STOP = object()


def _hashable(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running hashes of the parts' characters, a gap between parts, and where each part starts and ends."""
    chars = np.frombuffer("\0".join([*parts, ""]).encode("utf-32-le"), np.uint32)
    sums = np.empty(len(chars) + 1, sh.U)
    sums[0] = 0
    np.cumsum(sh.mix(chars.astype(sh.U) + sh.U(1)) * sh.powers(sh.BASE, len(chars)), out=sums[1:])
    ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64) - 1
    return sums, ends - np.array([len(p) for p in parts], np.int64), ends


def log_probabilities(scores: list[float], usable: list[bool]) -> list[float]:
    """Scores that may be added: those of a unigram model, or estimates from the ranks that a BPE model has instead."""
    given, used = np.array(scores, float), np.array(usable, bool)
    if used.any() and (given[used] == np.floor(given[used])).all() and given[used].max() <= 0:
        share = 1.0 / (ZIPF_SHIFT - given[used])
        given[used] = np.log(share / share.sum())
    return (np.round(given / SCORE_STEP) * SCORE_STEP).tolist()


def default_model() -> str:
    """The place of the installed 32,000-piece vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id with their scores, and the id of each byte's piece."""

    pieces: list[str]
    scores: list[float]
    usable: list[bool]
    byte_ids: list[int]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        pieces = [model.id_to_piece(i) for i in ids]
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(model.is_byte(i) for i in byte_ids):
            raise ValueError("the vocabulary needs a piece for every byte")
        usable = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in ids]
        return cls(pieces, log_probabilities([model.get_score(i) for i in ids], usable), usable, byte_ids)

    @cached_property
    def ids(self) -> dict[str, int]:
        return {p: i for i, p in enumerate(self.pieces) if self.usable[i]}

    @cached_property
    def prefixes(self) -> dict[str, float | None]:
        """The score of every piece, and None for what only begins one."""
        found: dict[str, float | None] = {}
        for piece in self.ids:
            for k in range(1, len(piece)):
                found.setdefault(piece[:k], None)
        return found | {p: float(self.scores[i]) for p, i in self.ids.items()}

    @cached_property
    def unknown(self) -> float:
        return min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY

    @cached_property
    def segments(self) -> re.Pattern:
        """Cuts a text where no piece can cross: before a space, and around white space that only stands alone."""
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            return re.compile(r"(?s).+")
        alone = "".join(c for c in "\n\t\r" if not any(c in p and len(p) > 1 for p in self.ids))
        apart = f"|[{alone}]" if alone else ""
        return re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+{apart}")

    @cached_property
    def piece_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """What every piece stands for, one after another, and where each begins."""
        said = [p.replace(SPACE, " ").encode() if u else b"" for p, u in zip(self.pieces, self.usable, strict=True)]
        for byte, i in enumerate(self.byte_ids):
            said[i] = bytes([byte])
        return np.frombuffer(b"".join(said), np.uint8), np.append(0, np.cumsum([len(s) for s in said]))

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("pieces", "scores", "usable", "byte_ids")}

    def edge_ids(self, part: str) -> list[int]:
        """The pieces of one edge of the lattice: a piece, or the bytes of an unknown character."""
        i = self.ids.get(part)
        return [i] if i is not None else [self.byte_ids[b] for b in part.encode()]

    def forward(self, segment: str) -> tuple[list[float], list[float], list[int]]:
        """Per place the best score from the start, the second best way to enter it, and where the best edge begins."""
        n, get, unknown = len(segment), self.prefixes.get, self.unknown
        best, second, back = [_NEVER] * (n + 1), [_NEVER] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            base = best[i]
            for e in range(i + 1, n + 1):
                score = get(segment[i:e], _STOP)
                if score is _STOP and e > i + 1:
                    break
                if score is None or score is _STOP:
                    if e > i + 1:
                        continue
                    stop, score = score is _STOP, unknown
                else:
                    stop = False
                value = base + score
                if value > best[e]:
                    second[e], best[e], back[e] = best[e], value, i
                elif value > second[e]:
                    second[e] = value
                if stop:
                    break
        return best, second, back

    @cached_property
    def table(self) -> tuple[Table, np.ndarray, np.ndarray]:
        """The prefixes by hash, with score (nan: no piece) and id."""
        names = list(self.prefixes)
        scores = np.array([np.nan if (x := self.prefixes[p]) is None else x for p in names], float)
        sums, starts, ends = _hashable(names)
        return Table(sh.span_hashes(sums, starts, ends)), scores, np.array([self.ids.get(p, -1) for p in names], np.int32)

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.ids), default=1)

    def solve_all(self, segments: list[str]) -> list[tuple[list[int], float, float]]:
        """`solve` of many segments at once: the forward pass goes over all of them place by place."""
        solved: list = [None] * len(segments)
        order = sorted((k for k, x in enumerate(segments) if len(x) <= SHORT), key=lambda k: -len(segments[k]))
        bounds = np.append(0, np.cumsum([len(segments[k]) for k in order]))
        for a, b in sh.chunks(bounds, SOLVED_CHARS):
            for k, x in zip(order[a:b], self._solve_together([segments[k] for k in order[a:b]]), strict=True):
                solved[k] = x
        return [x if x is not None else self.solve(p) for x, p in zip(solved, segments, strict=True)]

    def _solve_together(self, segments: list[str]) -> list[tuple[list[int], float, float] | None]:
        """Of segments sorted by falling length; None where the best one falls back to bytes."""
        table, scores, ids = self.table
        sums, starts, ends = _hashable(segments)
        nodes, sizes = len(sums), ends - starts
        edge = np.full((self.longest + 1, nodes), _NEVER)
        piece = np.full((self.longest + 1, nodes), -1, np.int32)
        place = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)  # one gap before each
        stop = np.repeat(ends, sizes)
        edge[1, place] = self.unknown
        for size in range(1, self.longest + 1):
            fits = place + size <= stop
            place, stop = place[fits], stop[fits]
            row = table.find(sh.span_hashes(sums, place, place + size))
            place, stop, row = place[row >= 0], stop[row >= 0], row[row >= 0]
            whole = ~np.isnan(scores[row])
            edge[size, place[whole]], piece[size, place[whole]] = scores[row[whole]], ids[row[whole]]
        best, second, back = np.full(nodes, _NEVER), np.full(nodes, _NEVER), np.zeros(nodes, np.int32)
        best[starts] = 0.0
        for at in range(1, int(sizes[0]) + 1):
            node = starts[: np.searchsorted(-sizes, -at, side="right")] + at
            lengths = np.arange(min(at, self.longest), 0, -1)
            ways = best[node[None, :] - lengths[:, None]] + edge[lengths[:, None], node[None, :] - lengths[:, None]]
            first = ways.argmax(axis=0)  # among equals the longest piece
            each = np.arange(len(node))
            best[node], back[node] = ways[first, each], lengths[first]
            ways[first, each] = _NEVER
            second[node] = ways.max(axis=0)
        gap, node, active = np.full(len(sizes), np.inf), ends.copy(), np.arange(len(sizes))
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(active):
            gap[active] = np.minimum(gap[active], best[node[active]] - second[node[active]])
            size = back[node[active]]
            node[active] -= size
            steps.append((active, piece[size, node[active]]))
            active = active[node[active] > starts[active]]
        paths: list[list[int]] = [[] for _ in segments]
        for who, found in reversed(steps):
            for k, i in zip(who.tolist(), found.tolist(), strict=True):
                paths[k].append(i)
        return [
            None if min(path) < 0 else (path, score, loss)
            for path, score, loss in zip(paths, best[ends].tolist(), gap.tolist(), strict=True)
        ]

    def solve(self, segment: str) -> tuple[list[int], float, float]:
        """The pieces and score of the best segmentation, and how much the second best loses."""
        best, second, back = self.forward(segment)
        parts, gap, at = [], float("inf"), len(segment)
        while at:
            gap = min(gap, best[at] - second[at])
            parts.append(segment[back[at] : at])
            at = back[at]
        return [i for p in reversed(parts) for i in self.edge_ids(p)], best[-1], gap

    def n_best(self, segment: str, n: int) -> list[tuple[float, list[int]]]:
        """The `n` best segmentations: A-star from the end, led by the exact forward scores."""
        best, _, _ = self.forward(segment)
        entries: list[list[tuple[int, float]]] = [[] for _ in range(len(segment) + 1)]
        for i in range(len(segment)):
            for e in range(i + 1, len(segment) + 1):
                score = self.prefixes.get(segment[i:e], _STOP)
                if e == i + 1 and not isinstance(score, float):
                    entries[e].append((i, self.unknown))
                elif isinstance(score, float):
                    entries[e].append((i, score))
                if score is _STOP:
                    break
        count, found = 0, []
        heap: list[tuple] = [(-best[-1], 0, len(segment), 0.0, None)]
        while heap and len(found) < n:
            _, _, at, done, path = heapq.heappop(heap)
            if at == 0:
                ids = []
                while path is not None:
                    part, path = path
                    ids += self.edge_ids(part)
                found.append((done, ids))
                continue
            for i, score in reversed(entries[at]):  # among equals the last one pushed, with the longest piece, comes first
                count -= 1
                heapq.heappush(heap, (-(best[i] + score + done), count, i, done + score, (segment[i:at], path)))
        return found


class Encoder(dict):
    """Numbers segments as they come and solves each once; `forget` bounds what is kept."""

    def __init__(self, vocabulary: Vocabulary, n_best: int) -> None:
        super().__init__()
        self.vocabulary, self.n = vocabulary, n_best
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.others: dict[int, list[tuple[float, list[int]]]] = {}
        self.names, self.fresh, self.chars = [], [], 0
        self.pool, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.scores, self.gaps = np.zeros(0), np.zeros(0)

    def __missing__(self, segment: str) -> int:
        self[segment] = at = len(self.names)
        self.names.append(segment)
        self.fresh.append(segment)
        self.chars += len(segment) + 16
        return at

    def _settle(self) -> None:
        if self.fresh:
            ids, scores, gaps = zip(*self.vocabulary.solve_all(self.fresh), strict=True)
            sizes = np.cumsum([len(x) for x in ids])
            self.pool = np.concatenate([self.pool, np.array([i for x in ids for i in x], np.int32)])
            self.starts = np.concatenate([self.starts, self.starts[-1] + sizes])
            self.scores, self.gaps = np.concatenate([self.scores, scores]), np.concatenate([self.gaps, gaps])
            self.fresh = []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[tuple[float, str]]]]:
        """All ids, where each text's begin, and per text its N best as (score, edits of the best)."""
        if self.chars > CACHED_CHARS:
            self.forget()
        cut, parts, sizes = self.vocabulary.segments.findall, [], []
        for text in texts:
            own = cut(SPACE + text.replace(" ", SPACE)) if text else []
            parts += own
            sizes.append(len(own))
        found = np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))
        self._settle()
        first = np.append(0, np.cumsum(sizes))
        begins, lengths = self.starts[found], self.starts[found + 1] - self.starts[found]
        upto = np.append(0, np.cumsum(lengths))
        ids = self.pool[np.repeat(begins - upto[:-1], lengths) + np.arange(upto[-1])]
        scores = np.append(0, np.cumsum(self.scores[found]))
        ranked = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            ranked.append(self._ranked(found[a:b], upto[a:b] - upto[a], float(scores[b] - scores[a]) if b > a else 0.0))
        return ids, upto[first], ranked

    def _ranked(self, found: np.ndarray, places: np.ndarray, score: float) -> list[tuple[float, str]]:
        """The N best of a text, each as its score and what it puts in place of parts of the best."""
        gaps, least = self.gaps[found], self.n - 1
        if least < 1 or not len(gaps):
            return [(score, "")]
        limit = np.partition(gaps, least - 1)[least - 1] if len(gaps) > least else np.inf
        near = np.flatnonzero((gaps <= limit) & (gaps < np.inf))
        near = near[np.argsort(gaps[near], kind="stable")][:least]
        ways: list[tuple[float, list[tuple[int, int]]]] = [(0.0, [])]
        for at in sorted(near.tolist()):
            ways = [
                (loss + self._loss(int(found[at]), k), [*edits, (at, k)] if k else edits)
                for loss, edits in ways
                for k in range(len(self._others(int(found[at]))))
            ]
            ways = sorted(ways, key=lambda w: (w[0], [(p, k) for p, k in w[1]]))[: self.n]
        return [(score - loss, ";".join(self._edit(found, places, p, k) for p, k in edits)) for loss, edits in ways]

    def _others(self, segment: int) -> list[tuple[float, list[int]]]:
        if segment not in self.others:
            self.others[segment] = self.vocabulary.n_best(self.names[segment], self.n)
            self.chars += 64 * self.n
        return self.others[segment]

    def _loss(self, segment: int, k: int) -> float:
        ways = self._others(segment)
        return ways[0][0] - ways[k][0]

    def _edit(self, found: np.ndarray, places: np.ndarray, at: int, k: int) -> str:
        segment = int(found[at])
        size = int(self.starts[segment + 1] - self.starts[segment])
        return f"{places[at]}:{size}:{' '.join(map(str, self._others(segment)[k][1]))}"


def edited(ids: list[int], edits: str) -> list[int]:
    """The segmentation that `edits` make of the best one: `place:pieces taken out:pieces put in`, joined by `;`."""
    out, at = [], 0
    for edit in filter(None, edits.split(";")):
        place, size, put = edit.split(":")
        out += ids[at : int(place)] + [int(i) for i in put.split()]
        at = int(place) + int(size)
    return out + ids[at:]


def decode_ids(ids: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> list[bytes]:
    """The UTF-8 bytes that each run of ids stands for, without the space in front."""
    data, starts = vocabulary.piece_bytes
    out = []
    for a, b in sh.chunks(offsets, 1 << 20):
        own = ids[offsets[a] : offsets[b]]
        begins, lengths = starts[own], starts[own + 1] - starts[own]
        upto = np.append(0, np.cumsum(lengths))
        said = data[np.repeat(begins - upto[:-1], lengths) + np.arange(upto[-1])].tobytes()
        places = upto[offsets[a : b + 1] - offsets[a]]
        out += [said[i:j] for i, j in zip(places[:-1], places[1:], strict=True)]
    return [x[1:] if x[:1] == b" " else x for x in out]


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def encode(documents: DataFrame, vocabulary: Vocabulary, n_best: int = N_BEST) -> DataFrame:
    """Per row: doc_id, n_pieces, ids, score, the N best as scores and edits, and whether decoding gives the text back."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)  # as large as the vocabulary file
    state: dict[str, Encoder] = {}

    def step(rows: pa.Table) -> pa.Table:
        if "encoder" not in state:
            state["encoder"] = Encoder(shared.value, n_best)
        encoder, texts = state["encoder"], texts_of(rows)
        parts: list[pa.Table] = []
        bounds = np.append(0, np.cumsum([len(x) for x in texts]))
        for a, b in sh.chunks(bounds, 1 << 20):
            ids, offsets, ranked = encoder.encode(texts[a:b])
            said = decode_ids(ids, offsets, shared.value)
            ends = np.append(0, np.cumsum([len(r) for r in ranked]))
            parts.append(
                pa.table(
                    {
                        "doc_id": rows["doc_id"].slice(a, b - a),
                        "n_pieces": np.diff(offsets).astype(np.int64),
                        "ids": _lists(ids, offsets),
                        "score": pa.array([r[0][0] for r in ranked], pa.float64()),
                        "nbest_scores": _lists(np.array([s for r in ranked for s, _ in r], float), ends),
                        "nbest_edits": pa.ListArray.from_arrays(
                            pa.array(ends, pa.int32()), pa.array([e for r in ranked for _, e in r], pa.string())
                        ),
                        "round_trip": [x == t.encode() for x, t in zip(said, texts[a:b], strict=True)],
                    }
                )
            )
        return pa.concat_tables(parts) if parts else None

    schema = (
        "doc_id long, n_pieces long, ids array<int>, score double, nbest_scores array<double>, "
        "nbest_edits array<string>, round_trip boolean"
    )
    return map_rows(documents.select(F.col("doc_id").cast("long"), "text"), step, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give a null text, bytes that are no UTF-8 the replacement character."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def step(rows: pa.Table) -> pa.Table:
        lists = rows["ids"].to_pylist()
        ids = np.array([i for x in lists for i in x or []], np.int64)
        offsets = np.append(0, np.cumsum([len(x or []) for x in lists]))
        said = decode_ids(ids, offsets, shared.value)
        texts = [None if x is None else s.decode("utf-8", "replace") for x, s in zip(lists, said, strict=True)]
        return pa.table({"doc_id": rows["doc_id"], "text": pa.array(texts, pa.string())})

    return map_rows(encoded.select(F.col("doc_id").cast("long"), "ids"), step, "doc_id long, text string")
