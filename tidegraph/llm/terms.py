"""Terms of UTF-8 texts: maximal runs of kept bytes, with A-Z in lower case.

Every byte from 128 on is kept, so a run of bytes is a run of characters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 22
_LETTERS = b"abcdefghijklmnopqrstuvwxyz"
_DIGITS = b"0123456789"


def _mapping(kept: bytes) -> bytes:
    out = bytearray(b" " * 128 + bytes(range(128, 256)))
    for byte in kept:
        out[byte] = byte
    for byte in _LETTERS:
        out[byte - 32] = byte
    return bytes(out)


LETTERS = _mapping(_LETTERS)
ALPHANUMERIC = _mapping(_LETTERS + _DIGITS)


def pieces(text: bytes, mapping: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded total size, however long the text."""
    mapped = text.translate(mapping)
    at = 0
    while len(mapped) - at > PIECE_BYTES:
        end = mapped.find(b" ", at + PIECE_BYTES)
        if end < 0:
            break
        yield mapped[at:end].split()
        at = end
    yield mapped[at:].split() if at else mapped.split()


def bag(text: bytes, mapping: bytes) -> Counter[bytes]:
    counts: Counter[bytes] = Counter()
    for some in pieces(text, mapping):
        counts.update(some)
    return counts


def _vector(text: bytes, mapping: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of one text, and per term its place among them and its count."""
    held = bag(text, mapping)
    return pa.array(list(held), pa.large_binary()), np.arange(len(held)), np.fromiter(held.values(), np.int64, len(held))


def vectors(
    texts: list[bytes], mapping: bytes, number: Callable[[pa.Array], np.ndarray]
) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """The bags of the texts as sparse vectors, in slices of bounded total size: (terms, text, index, count).

    `number` gives the distinct terms of a slice their indices, those below 0 being left out.  Entries go by the
    place of their text, then by index.  A text too long for a slice is one of its own.
    """
    places, mapped, size = [], [], 0
    for place, text in enumerate(texts):
        if size + len(text) > PIECE_BYTES and mapped:
            yield _slice(places, mapped, number)
            places, mapped, size = [], [], 0
        if len(text) > PIECE_BYTES:
            terms, term, count = _vector(text, mapping)
            index = number(terms)[term]
            order = np.argsort(index)
            order = order[index[order] >= 0]
            yield terms, np.full(len(order), place), index[order], count[order]
        elif kept := text.translate(mapping).strip():
            places.append(place)
            mapped.append(kept)
            size += len(text)
    if mapped:
        yield _slice(places, mapped, number)


def _slice(places: list[int], mapped: list[bytes], number: Callable[[pa.Array], np.ndarray]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    # Blank is the only white space left, so bytes that are no valid UTF-8 are kept like any others.
    split = pc.ascii_split_whitespace(pa.array(mapped, pa.large_binary()).view(pa.large_string()))
    coded = split.flatten().dictionary_encode()
    terms = coded.dictionary.view(pa.large_binary())
    index = number(terms)[np.asarray(coded.indices)]
    text = np.repeat(np.array(places), np.asarray(split.value_lengths()))
    known = index >= 0
    width = int(index.max()) + 1 or 1
    entry, count = np.unique(text[known] * width + index[known], return_counts=True)
    return terms, entry // width, entry % width, count


def utf8_texts(rows: pa.Table | pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as bytes; null counts as empty."""
    return [x or b"" for x in rows[column].cast(pa.large_binary()).to_pylist()]
