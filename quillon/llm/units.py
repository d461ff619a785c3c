"""Texts of an Arrow column cut into units, all at once and in their bytes.

Where units start is worked out for the bytes of many texts together; Arrow
then numbers the distinct units, so that Python meets each of them once a
column and not once an occurrence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .tokens import SPACE

CHUNK_BYTES = 3 << 20  # text that is cut at a time

_SPACES = [x.encode() for x in map(chr, range(0x10000)) if re.match(f"[{SPACE}]", x)]
_WIDE_SPACES = {
    lead: [x for x in _SPACES if len(x) > 1 and x[0] == lead]
    for lead in sorted({x[0] for x in _SPACES if len(x) > 1})
}
#: Second bytes of À to ÿ without × and ÷: behind 0xC3 they end a letter.
_LATIN = np.zeros(256, bool)
_LATIN[[c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)]] = True


def chunks(column: pa.Array, limit: int | None = None) -> Iterator[pa.Array]:
    """Runs of the texts of ``column`` of about ``limit`` bytes (else
    ``CHUNK_BYTES``); null is empty."""
    limit = limit or CHUNK_BYTES
    column = pc.fill_null(column.cast(pa.string()), "")
    ends = offsets(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(ends, ends[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield column.slice(first, last - first)
        first = last


def offsets(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]


def packed(ends: np.ndarray, data) -> pa.Array:
    """A binary array from offsets and bytes."""
    return pa.Array.from_buffers(
        pa.binary(),
        len(ends) - 1,
        [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)],
    )


def pack(values: list[bytes]) -> pa.Array:
    ends = np.zeros(len(values) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, values), np.int64, len(values)), out=ends[1:])
    return packed(ends, b"".join(values))


def joined(values: list[bytes] | pa.Array, number: np.ndarray) -> tuple[np.ndarray, pa.Buffer]:
    """The ``values`` that ``number`` names, one behind the other, and where each
    starts (and the last ends)."""
    values = values if isinstance(values, pa.Array) else pack(values)
    taken = values.take(pa.array(number))
    return offsets(taken), taken.buffers()[2] or pa.py_buffer(b"")


class Units:
    """Units of some texts.

    A unit is a run without white space, with the space before it, or a run of
    white space that leaves the next word its space (``words``: runs without
    white space alone).  A run is also cut between a letter or digit of ASCII
    or Latin-1 and an ASCII sign behind it, but not inside the strings ``whole``.

    ``units`` has them one behind the other as a binary array, and ``first`` at
    which place each text starts (and the last ends).
    """

    def __init__(self, texts: pa.Array, words: bool = False, whole: tuple[bytes, ...] = ()):
        ends = offsets(texts)
        data = texts.buffers()[2]
        b = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        text = np.zeros(len(b) + 1, bool)  # where texts start
        text[ends] = True
        space = (b == 32) | (b - np.uint8(9) < 5)
        wide = False
        for lead, some in _WIDE_SPACES.items():
            leads = np.flatnonzero(b == lead)
            for x in some if len(leads) else ():
                at = leads
                for k in range(1, len(x)):
                    at = at[b[at + k] == x[k]]
                for k in range(len(x)):
                    space[at + k] = True
                wide = wide or len(at) > 0
        before = ((b | 32) - np.uint8(97) < 26) | (b - np.uint8(48) < 10)  # letters, digits
        start = (b - np.uint8(33) < 94) & ~before
        before = before[:-1]
        latin = np.flatnonzero(b[:-2] == 0xC3) + 1
        before[latin] = _LATIN[b[latin]]
        start[:1] = False
        start[1:] &= before
        plain = b.tobytes() if whole or words else b""
        for x in whole:
            at = plain.find(x)
            while at >= 0:
                start[at + 1 : at + len(x)] = False
                at = plain.find(x, at + 1)
        change = text[:-1].copy()
        change[1:] |= space[1:] != space[:-1]
        if words:
            start |= change & ~space
            at = np.flatnonzero(start)
            first = np.searchsorted(at, ends)
            at = at - np.cumsum(space, dtype=np.int32)[at]  # the places without white space
            b = b[~space] if wide else np.frombuffer(plain.translate(None, b" \t\n\v\f\r"), np.uint8)
        else:
            edge = np.flatnonzero(change).astype(np.int32)
            start[edge] = True
            # the last white space before a word: a space belongs to the word
            own = edge[~space[edge] & ~text[edge]]
            last = own - 1
            for _ in range(2):
                last = last - ((b[last] & 0xC0) == 0x80)
            start[last] = True
            start[own[b[own - 1] == 32]] = False
            at = np.flatnonzero(start)
            first = np.searchsorted(at, ends)
        self.first = first
        self.units = packed(np.append(at, len(b)), np.ascontiguousarray(b))


class Cut(Units):
    """Units of some texts, each numbered: ``distinct`` has each unit once, and
    ``number`` says which of them stands at each place."""

    def __init__(self, texts: pa.Array, words: bool = False, whole: tuple[bytes, ...] = ()):
        super().__init__(texts, words, whole)
        coded = self.units.dictionary_encode()
        self.number = coded.indices.to_numpy()
        plain, at = coded.dictionary.buffers()[2], offsets(coded.dictionary).tolist()
        plain = plain.to_pybytes() if plain else b""
        self.distinct = [plain[i:j] for i, j in zip(at, at[1:])]
