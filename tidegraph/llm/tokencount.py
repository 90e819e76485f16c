"""Token counts of a SentencePiece BPE model by whole tokens, merging only what is left.

Spaces become U+2581 and one is put before the text, as the library does.  A pre-token is a
run of U+2581 with the characters after it.  If no piece of the vocabulary has U+2581 behind another
character, no merge can join two pre-tokens, so a text has as many tokens as its pre-tokens have.

`prove` works before any text is seen: it checks that the library changes no character but
the space, that no piece crosses pre-tokens, and encodes every vocabulary string of a pre-token's shape; those that
come back as the one token they name count 1 from then on.  Any other pre-token is merged by the library, once per
task and pre-token; at most `CACHED` short ones are remembered.  A model for which the proof fails gives each text whole
to the library, with equal counts.

A null text counts as empty: 0 bytes, 0 tokens.  Rows are neither dropped nor joined: a null
or repeated doc_id stays as it is, other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.base import map_rows, utf8

LIMIT = 4_096
CACHED = 500_000
CACHED_CHARS = 64
PIECE_CHARS = 1 << 20
SPACE = "▁"
_PRETOKEN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Proof:
    """The model file's bytes, whether pre-tokens are independent, and the pre-tokens that are one token each."""

    model: bytes
    separable: bool
    whole: frozenset[str]


def _every_character() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


def prove(path: str) -> Proof:
    with open(path, "rb") as file:
        model = file.read()
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = [library.id_to_piece(k) for k in range(library.get_piece_size())]
    probes = [_every_character(), "  a  b  ", " " + SPACE]
    plain = all(library.normalize(x) == SPACE + x.replace(" ", SPACE) for x in probes)
    crossing = any(SPACE in name.lstrip(SPACE) for name in names)
    if not plain or crossing:
        return Proof(model, False, frozenset())
    shaped = [(k, name) for k, name in enumerate(names) if name.startswith(SPACE) and len(name) > 1]
    ids = library.encode([name[1:] for _, name in shaped], num_threads=1)
    return Proof(model, True, frozenset(name for (k, name), got in zip(shaped, ids, strict=True) if got == [k]))


class Counts(dict):
    """Tokens per pre-token: the proven ones from the start, the others merged when they are met."""

    def __init__(self, proof: Proof) -> None:
        super().__init__(dict.fromkeys(proof.whole, 1))
        self.proof, self.merged = proof, 0
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proof.model)

    def __missing__(self, pretoken: str) -> int:
        # The library puts the first U+2581 there itself; a lone one it would not, as the text is empty then.
        n = len(self.library.encode(pretoken[1:])) if len(pretoken) > 1 else self._lone()
        if len(pretoken) <= CACHED_CHARS:
            if self.merged >= CACHED:
                self.clear()
                self.update(dict.fromkeys(self.proof.whole, 1))
                self.merged = 0
            self[pretoken] = n
            self.merged += 1
        return n

    def _lone(self) -> int:
        """Tokens of a pre-token that is one U+2581 only: what it adds behind a letter."""
        return len(self.library.encode("a ")) - len(self.library.encode("a"))

    def of(self, text: str) -> int:
        if not text:
            return 0
        if not self.proof.separable:
            return len(self.library.encode(text))
        count, total = self.__getitem__, 0
        spaced, at = SPACE + text.replace(" ", SPACE), 0
        while len(spaced) - at > PIECE_CHARS:  # cut long texts where a pre-token begins
            end = _boundary(spaced, at + PIECE_CHARS)
            total += sum(map(count, _PRETOKEN.findall(spaced, at, end)))
            at = end
        return total + sum(map(count, _PRETOKEN.findall(spaced, at)))


_BEGIN = re.compile(f"(?<=[^{SPACE}]){SPACE}")


def _boundary(spaced: str, at: int) -> int:
    found = _BEGIN.search(spaced, at)
    return found.start() if found else len(spaced)


def token_counts(documents: DataFrame, proof: Proof, limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit."""
    shared = documents.sparkSession.sparkContext.broadcast(proof)  # the model file, the same for any input
    held: list[Counts] = []

    def step(rows: pa.Table) -> pa.Table:
        if not held:
            held.append(Counts(shared.value))
        n = [held[0].of(x or "") for x in rows["text"].to_pylist()]
        return pa.table({"doc_id": rows["doc_id"], "n_bytes": rows["n_bytes"], "n_tokens": pa.array(n, pa.int64())})

    rows = documents.select(F.col("doc_id").cast("long"), F.octet_length(utf8("text")).cast("long").alias("n_bytes"), "text")
    counted = map_rows(rows, step, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
