"""Token-id files: an adaptive context-mixing range coder over id blocks.

An id stream is cut into blocks that are coded independently: each starts
without any model and carries its own checksum.  Within a block the models are
taught by the ids coded so far and renewed at the ends of its spans, each of
which is as long as all spans before it and more.

For every id, its two predecessors (order 2) or, where these are new, its one
predecessor (order 1) name a few likely ids.  The probability of each is mixed
from its order-2, order-1 and order-0 shares, with weights for each level of
confidence that are fitted to the last span before they are used on the next.
What the named ids leave goes to all ids by their order-0 shares; an id that
the block has not held yet is spelled out.  The choices are coded by a range
coder with a 63-bit interval; carries are added to its words at the end.

A span is dealt to many lanes, each with a coder of its own, and the lanes run
in lockstep: one numpy operation serves the same place of all lanes.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table
from .tokens import BATCH_BYTES, LONG_UNIT, balanced
from .units import Units, chunks, joined, offsets, pack, packed

MAGIC = b"QIDS4\0"
BLOCK = 7 << 20  # ids a block; a fifth of a full one teaches its last model
DISTINCT = 65_000  # distinct ids of a block of more ids than that
SEGMENT_IDS = 13 << 19  # a segment ends with the batch of documents that fills it
FIRST_SPAN, GROWTH = 96, 4  # a span ends where the block is GROWTH times as long
LANE_IDS, LANES = 256, 4096  # ids of a lane, as long as there are lanes enough
NAMED = 4  # ids that a context names
TOTAL0 = 17  # bits of the order-0 frequencies
NAMED_SHARE = 60_000  # of 65,536, what the named ids have together at most
LEVELS = 8  # of confidence: by the logarithm of a context's count
AT_ONCE = 1 << 17  # ids whose choices are worked out at a time
AT_A_TIME = 3000  # documents that are encoded at a time
CUT_BYTES = 16 << 20  # text that is cut into words at a time
LINES = 2000  # words that the model gets in one text
KEPT_WORDS = 3 << 17  # words that a worker keeps before it forgets half of them
SAMPLE = 8  # the weights are fitted to one id of so many
NEW, START = 65_535, 65_534  # as contexts: an id not held before, the start of a lane

_U = np.uint64
_MIX = np.uint32(0x9E3779B1)
_FULL = _U(1 << 63)  # the longest interval; one below 1 << 31 is shifted
_M16, _M18, _M31, _M32 = _U(0xFFFF), _U(0x3FFFF), _U(0x7FFFFFFF), _U(0xFFFFFFFF)
_ALL4 = _U(0x1000100010001)  # times 16 bits: four times the same
NOBODY = _U(START) * _ALL4  # the names of a context that names no id


class _Encoder:
    """A range coder for each lane: low end and length of its interval."""

    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, _U)
        self.length = np.full(lanes, _FULL)
        self.out: list[tuple[np.ndarray, np.ndarray]] = []

    def choose(self, k: int, choice: np.ndarray, choice0: np.ndarray) -> None:
        """The first ``k`` lanes: a 16-bit choice, then one of ``TOTAL0`` bits or
        none.  Both are packed: start, size, and what to shift by."""
        low, length = self.low[:k], self.length[:k]
        unit = length >> _U(16)
        low += unit * (choice & _M16)
        unit *= (choice >> _U(16)) & _M18
        unit >>= choice >> _U(40)
        low += unit * (choice0 & _M18)
        np.multiply(unit, choice0 >> _U(18), out=length)
        short = (length <= _M31).nonzero()[0]
        if len(short):  # 32 bits go out, with what they carry to the word before
            own = low[short]
            self.out.append((short, own >> _U(31)))
            low[short] = (own & _M31) << _U(32)
            length[short] = length[short] << _U(32)

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of each lane, lane by lane, and how many each has."""
        every = np.arange(len(self.low))
        # the value in the interval that ends in 31 zeros, which are not written
        self.out.append((every, (self.low + _M31) >> _U(31)))
        lane, word = (np.concatenate(x) for x in zip(*self.out))
        word = word[np.argsort(lane.astype(np.uint16), kind="stable")]
        carry = np.flatnonzero(word > _M32)
        while len(carry):  # never from a lane's first word
            word[carry] &= _M32
            word[carry - 1] += _U(1)
            carry = carry[word[carry - 1] > _M32] - 1
        return word.astype(np.uint32), np.bincount(lane, minlength=len(every)).astype("<u2")


class _Decoder:
    """Of each lane: length of its interval, and where in it the coded value lies."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        # a lane's bits begin with a zero, as its interval has 63: one word more
        stop = np.cumsum(counts, dtype=np.int64)
        words = words.astype(np.uint32)
        odd = (words & np.uint32(1)) << np.uint32(31)
        before = np.append(np.uint32(0), odd[:-1])
        before[stop[:-1]] = 0
        words = np.insert(words >> np.uint32(1) | before, stop, odd[stop - 1])
        self.words = words.astype(_U)
        self.at = stop - counts + np.arange(len(counts))
        self.length = np.full(len(counts), _FULL)
        self.value = self.words[self.at] << _U(32) | self.words[self.at + 1]
        self.at += 2

    def choose(
        self, k: int, ends: np.ndarray, names: np.ndarray, model: "_Model"
    ) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the first ``k`` lanes, and which lanes have a new id."""
        value, length = self.value[:k], self.length[:k]
        unit = length >> _U(16)
        share = value // unit
        share *= _ALL4
        place = np.bitwise_count((share.view(np.uint16) >= ends.view(np.uint16)).view(np.uint32))
        none = (place == NAMED).nonzero()[0]
        by = place.astype(_U)
        by <<= _U(4)
        now = names >> by
        now &= _M16
        start = ends << _U(16)
        start >>= by
        start &= _M16
        size = ends >> by
        size &= _M16
        size -= start
        start *= unit
        value -= start
        np.multiply(unit, size, out=length)
        # not named: an order-0 symbol in what is left
        own, last = unit.take(none), ends.take(none)
        last >>= _U(16 * NAMED - 16)
        at = value.take(none)
        at -= own * last
        own *= _U(1 << 16) - last
        own >>= _U(TOTAL0)
        symbol = model.symbols.take((at // own).view(np.int64))
        packed0 = model.packed0.take(symbol)
        value[none] = at - own * (packed0 & _M18)
        length[none] = own * (packed0 >> _U(18))
        now[none] = symbol
        short = (length <= _M31).nonzero()[0]
        if len(short):
            at = self.at.take(short)
            value[short] = value.take(short) << _U(32) | self.words.take(at)
            length[short] = length.take(short) << _U(32)
            self.at[short] = at + 1
        return now, none[symbol == model.known]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of sorted ``keys`` and their counts."""
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[edge], np.diff(np.r_[edge, len(keys)])


def _best(context: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of entries sorted by context: each context's start and sum of counts, and
    its NAMED largest entries (number, place of the context, rank)."""
    first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
    sums = np.add.reduceat(n, first)
    run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(context)]))
    inside = np.arange(len(context)) - first[run]
    order = np.sort((run << 42) | (((1 << 21) - n) << 21) | inside)
    rank = np.arange(len(order)) - first[order >> 42]
    order, rank = order[rank < NAMED], rank[rank < NAMED]
    run = order >> 42
    return first, sums, first[run] + (order & ((1 << 21) - 1)), run, rank


def _level(sums: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(sums, 1)).astype(np.int64), LEVELS - 1)


class _Model:
    """What a block's ids so far, as symbols 0, 1, ... in their order of
    appearance, say about its next span."""

    def __init__(self, seen: np.ndarray, known: int, weights: np.ndarray):
        self.known, self.weights, self.n = known, weights, len(seen)
        counts = np.bincount(seen, minlength=known)[:known]
        total = 1 << TOTAL0
        size = 1 + counts * (total - known - max(1, total >> 10)) // max(1, len(seen))
        size = np.append(size, total - size.sum())  # what is left: a new id
        self.counts = np.append(counts, 0)
        self.packed0 = (np.cumsum(size) - size).astype(_U) | size.astype(_U) << _U(18)
        self.symbols = np.repeat(np.arange(known + 1, dtype=np.uint16), size)
        self.bits = max(8, min(18, int(len(seen) // 4).bit_length()))
        slots = 1 << self.bits
        self.ends = np.zeros(slots + (1 << 16), _U)
        self.names = np.full(slots + (1 << 16), NOBODY)
        self.tags = np.full(slots, 0xFFFFFFFF, np.uint32)
        if len(seen) < 3:
            self.pairs, self.triples = np.zeros(0, np.uint32), np.zeros(0, _U)
            return
        s = seen.astype(_U)
        pairs = s[:-1] << _U(16) | s[1:]
        self.pairs, self.n1 = _runs(np.sort(pairs.astype(np.uint32)))
        self.triples, self.n2 = _runs(np.sort(pairs[:-1] << _U(16) | s[2:]))
        context = (self.pairs >> _U(16)).astype(np.int64)
        first, sums, entry, run, rank = _best(context, self.n1)
        self.sum1 = np.zeros(1 << 16, np.int64)
        self.sum1[context[first]] = sums
        symbol = self.pairs[entry] & _M16
        share = self._mixed(1, _level(sums)[run], 0.0, self.n1[entry] / sums[run], symbol)
        self._fill(slots + context[first], slice(None), run, rank, symbol, share)
        context = self.triples >> _U(16)
        first, sums, entry, run, rank = _best(context, self.n2)
        contexts, self.sum2 = context[first], sums
        self.contexts = contexts.astype(np.uint32)
        pair = (self.triples[entry] & _M32).astype(np.uint32)
        at = np.searchsorted(self.pairs, pair)
        share1 = self.n1[at] / self.sum1[pair >> np.uint32(16)]
        symbol = pair & np.uint32(0xFFFF)
        share = self._mixed(2, _level(sums)[run], self.n2[entry] / sums[run], share1, symbol)
        place = self.slot(self.contexts)
        # of contexts in one slot the most frequent stays
        by_count = np.argsort(sums, kind="stable")
        owner = np.full(slots, -1)
        owner[place[by_count]] = by_count
        kept = owner[place] == np.arange(len(place))
        self.tags[place[kept]] = self.contexts[kept]
        self._fill(place, kept, run, rank, symbol, share)

    def slot(self, context: np.ndarray) -> np.ndarray:
        return ((context * _MIX) >> np.uint32(32 - self.bits)).astype(np.int64)

    def _mixed(self, order, level, share2, share1, symbol):
        w = self.weights[order, level]
        return w[:, 2] * share2 + w[:, 1] * share1 + w[:, 0] * self.counts[symbol.astype(np.int64)] / self.n

    def _fill(self, rows, kept, run, rank, symbol, share):
        at = run * NAMED + rank
        size = np.zeros(len(rows) * NAMED, "<u2")
        size[at] = (share * NAMED_SHARE).astype("<u2")
        name = np.full(len(size), START, "<u2")
        name[at] = symbol
        name[size == 0] = START
        size = size.reshape(-1, NAMED)
        for n in range(1, NAMED):
            size[:, n] += size[:, n - 1]
        rows = rows[kept]
        self.ends[rows] = size.view("<u8")[kept, 0]
        self.names[rows] = name.view("<u8")[kept]

    def rows(self, context: np.ndarray, before1: np.ndarray) -> np.ndarray:
        """Rows of ``ends`` and ``names`` for two predecessors and for the last of these."""
        slot = self.slot(context)
        return np.where(self.tags.take(slot) == context, slot, before1 + (1 << self.bits))

    def fitted(self, before2, before1, symbol) -> np.ndarray:
        """Weights for what follows these ids, by expectation maximisation."""
        weights = self.weights.copy()
        if not len(self.triples) or not len(symbol):
            return weights
        triple = np.sort(before2 << _U(32) | before1 << _U(16) | symbol)  # sums know no order
        context, pair = ((triple >> _U(16)).astype(np.uint32), triple.astype(np.uint32))
        before1, symbol = context & np.uint32(0xFFFF), triple & _M16
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        sum1 = self.sum1[before1.astype(np.int64)]
        share1 = np.where(self.pairs[at] == pair, self.n1[at], 0) / np.maximum(sum1, 1)
        at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        sum2 = np.where(self.contexts[at] == context, self.sum2[at], 0)
        at = np.minimum(np.searchsorted(self.triples, triple), len(self.triples) - 1)
        share2 = np.where(self.triples[at] == triple, self.n2[at], 0) / np.maximum(sum2, 1)
        share0 = (self.counts[np.minimum(symbol, _U(self.known)).astype(np.int64)] + 0.01) / self.n
        for order, some in ((2, sum2 > 0), (1, (sum2 == 0) & (sum1 > 0))):
            level = _level(sum2 if order == 2 else sum1)[some]
            parts = [x[some] for x in (share0, share1, share2 if order == 2 else share2 * 0)]
            for _ in range(4):
                w = weights[order, level]
                own = [w[:, k] * p for k, p in enumerate(parts)]
                whole = own[0] + own[1] + own[2] + 1e-12
                sums = np.stack([np.bincount(level, x / whole, LEVELS) for x in own], axis=1)
                sums = sums + weights[order] * 20  # a level with few ids stays near its weights
                weights[order] = sums / sums.sum(axis=1, keepdims=True)
        return np.round(weights * 4096) / 4096


def _first_weights() -> np.ndarray:
    """By order, level and share: what orders 0, 1 and 2 count for."""
    weights = np.zeros((3, LEVELS, 3))
    weights[1], weights[2] = (0.5, 0.5, 0.0), (0.4, 0.3, 0.3)
    return weights


def _spans(n: int) -> list[tuple[int, int]]:
    ends = [0, min(n, FIRST_SPAN)]
    while ends[-1] < n:
        ends.append(min(n, ends[-1] * GROWTH))
    if len(ends) > 2 and ends[-1] - ends[-2] < ends[-2] // 4:  # no short last span
        del ends[-2]
    return list(zip(ends, ends[1:]))


def _lanes(n: int) -> tuple[int, int]:
    """Steps and lanes for a span of ``n`` ids; all lanes but the last are full."""
    steps = -(-n // max(1, min(LANES, n // LANE_IDS)))
    return steps, -(-n // steps)


def _next_weights(model: _Model, symbols: np.ndarray, first: int, last: int) -> np.ndarray:
    at = np.arange(max(first, 2), last, SAMPLE)
    return model.fitted(*(symbols[at - k].astype(_U) for k in (2, 1, 0)))


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids in ascending order, and the place of each id among them."""
    top = int(ids.max(initial=0))
    if top >> 22:
        return np.unique(ids, return_inverse=True)
    there = np.zeros(top + 1, bool)
    there[ids] = True
    place = (np.cumsum(there) - 1).astype(np.int32)
    return np.flatnonzero(there), place[ids]


def _choices(model: _Model, now: np.ndarray, steps: int):
    """What codes the symbols ``now`` of some lanes, packed for a coder."""
    own = now.astype(_U)
    before1, before2 = np.empty((2, len(now)), np.uint32)
    before1[1:] = now[:-1]
    before1[::steps] = START
    before2[1:] = before1[:-1]
    before2[::steps] = START
    row = model.rows(before2 << np.uint32(16) | before1, before1.astype(np.int64))
    ends, names = model.ends.take(row), model.names.take(row)
    hit = names.astype("<u8", copy=False).view("<u2") == (own * _ALL4).view("<u2")
    hit = hit.view("<u4")
    by = (np.bitwise_count(hit - np.uint32(1)) >> 3).astype(_U) << _U(4)
    start = ((ends << _U(16)) >> by) & _M16
    choice = start | (((ends >> by) & _M16) - start) << _U(16)
    none = np.flatnonzero(hit == 0)
    last = ends[none] >> _U(16 * NAMED - 16)
    choice[none] = last | (_U(1 << 16) - last) << _U(16) | _U(TOTAL0 << 40)
    choice0 = np.full(len(own), 1 << 18, _U)
    choice0[none] = model.packed0[np.minimum(own[none].astype(np.int64), model.known)]
    return choice, choice0


def encode_block(ids: np.ndarray, numbered=None) -> bytes:
    """The payload of a block: for each span its new ids as they are, by step and
    lane, and the words of its lanes."""
    distinct, at = numbered or _numbered(ids)
    symbol_of = np.full(len(distinct), NEW, np.int32)
    symbols = np.zeros(len(ids), np.int32)
    known, weights, out = 0, _first_weights(), []
    for first, last in _spans(len(ids)):
        model = _Model(symbols[:first], known, weights)
        now = symbol_of[at[first:last]]
        steps, lanes = _lanes(last - first)
        choice, choice0 = np.zeros((2, steps, lanes), _U)
        some = max(1, AT_ONCE // steps)
        for lane in range(0, lanes, some):
            part = now[lane * steps : (lane + some) * steps]
            full, rest = divmod(len(part), steps)
            for whole, own in zip((choice, choice0), _choices(model, part, steps)):
                whole[:, lane : lane + full] = own[: full * steps].reshape(full, steps).T
                if rest:
                    whole[:rest, lane + full] = own[full * steps :]
        new = np.flatnonzero(now == NEW)
        new = new[np.argsort(new % steps, kind="stable")]  # by step, then by lane
        coder = _Encoder(lanes)
        full = len(now) - steps * (lanes - 1)  # ids of the last lane
        for t in range(steps):
            k = lanes if t < full else lanes - 1
            coder.choose(k, choice[t, :k], choice0[t, :k])
        words, counts = coder.finish()
        out += [struct.pack("<II", len(words), len(new)), counts.tobytes()]
        out += [ids[first + new].astype("<u4").tobytes(), words.astype("<u4").tobytes()]
        # new ids of the span get the next symbols, in ascending order
        fresh = np.unique(at[first:last][new])
        symbol_of[fresh] = np.arange(known, known + len(fresh))
        known += len(fresh)
        if last < len(ids):
            symbols[first:last] = symbol_of[at[first:last]]
            weights = _next_weights(model, symbols, first, last)
    return b"".join(out)


def decode_block(n: int, payload: bytes) -> np.ndarray:
    id_of = np.zeros(0, np.uint32)
    symbols = np.zeros(n, np.int32)
    weights, at = _first_weights(), 0
    for first, last in _spans(n):
        known = len(id_of)
        model = _Model(symbols[:first], known, weights)
        steps, lanes = _lanes(last - first)
        size, n_new = struct.unpack_from("<II", payload, at)
        at += 8
        counts = np.frombuffer(payload, "<u2", lanes, at)
        if counts.sum(dtype=np.int64) != size:
            raise ValueError("a block of ids is damaged")
        at += 2 * lanes
        value = np.frombuffer(payload, "<u4", n_new, at)
        words = np.frombuffer(payload, "<u4", size, at + 4 * n_new)
        at += 4 * (size + n_new)
        coder = _Decoder(words, counts.astype(np.int64))
        got = np.zeros((steps, lanes), np.uint16)
        spelled: list[np.ndarray] = []
        before1 = np.full(lanes, START)
        context = np.full(lanes, START << 16 | START, np.uint32)
        full = last - first - steps * (lanes - 1)
        for t in range(steps):
            k = lanes if t < full else lanes - 1
            row = model.rows(context[:k], before1[:k])
            now, new = coder.choose(k, model.ends.take(row), model.names.take(row), model)
            if len(new):
                spelled.append(new * steps + t)
                now[new] = NEW
            got[t, :k] = now
            before1 = now.view(np.int64)
            context = context[:k] << np.uint32(16)
            context |= now.astype(np.uint32)
        own = np.ascontiguousarray(got.T).reshape(-1)[: last - first].astype(np.int32)
        if n_new or spelled:
            where = np.concatenate([*spelled, np.zeros(0, np.int64)])
            if len(where) != n_new:
                raise ValueError("a block of ids is damaged")
            fresh, symbol = np.unique(value.astype(np.uint32), return_inverse=True)
            own[where] = known + symbol
            id_of = np.append(id_of, fresh)
        symbols[first:last] = own
        if last < n:
            weights = _next_weights(model, symbols, first, last)
    return id_of[symbols]


def encode_ids(ids: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Blocks of an id stream: number of ids, checksum of the ids, payload."""
    blocks, first = [], 0
    while first < len(ids):
        size = min(BLOCK, len(ids) - first)
        while len((numbered := _numbered(ids[first : first + size]))[0]) > DISTINCT:
            size = max(DISTINCT, size // 2)
        part = ids[first : first + size].astype("<u4")
        blocks.append((size, zlib.crc32(part), encode_block(part, numbered)))
        first += size
    return blocks


def decode_ids(blocks: list[tuple[int, int, bytes]]) -> np.ndarray:
    """The id stream of ``encode_ids``; a damaged block raises ValueError."""
    out = []
    for number, (n, crc, payload) in enumerate(blocks):
        try:
            part = decode_block(n, payload)
            right = zlib.crc32(np.ascontiguousarray(part, "<u4")) == crc
        except (IndexError, ValueError, struct.error):
            right = False
        if not right:
            raise ValueError(f"block {number}: the checksum does not match")
        out.append(part)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def pack_segment(doc_ids: list[int | None], streams: list[np.ndarray]) -> bytes:
    """One segment: header, table of documents, coded blocks."""
    counts = np.array([len(s) for s in streams], "<i8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    table = zlib.compress(
        np.array([d or 0 for d in doc_ids], "<i8").tobytes() + counts.tobytes() + known.tobytes()
    )
    blocks = encode_ids(np.concatenate(streams)) if streams else []
    head = struct.pack("<6sIIII", MAGIC, len(doc_ids), len(table), len(blocks), zlib.crc32(table))
    out = [head, table]
    for n, crc, payload in blocks:
        out += [struct.pack("<III", n, crc, len(payload)), payload]
    return b"".join(out)


def unpack_segment(data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """Documents of a segment with their ids; damage raises ValueError."""
    magic, n_docs, size, n_blocks, crc = struct.unpack_from("<6sIIII", data)
    at = struct.calcsize("<6sIIII")
    table = data[at : at + size]
    if magic != MAGIC or zlib.crc32(table) != crc:
        raise ValueError("not a segment of ids")
    table = zlib.decompress(table)
    doc_ids = np.frombuffer(table, "<i8", n_docs)
    counts = np.frombuffer(table, "<i8", n_docs, 8 * n_docs)
    known = np.frombuffer(table, np.uint8, n_docs, 16 * n_docs)
    at += size
    blocks = []
    for _ in range(n_blocks):
        n, crc, length = struct.unpack_from("<III", data, at)
        at += 12
        blocks.append((n, crc, data[at : at + length]))
        at += length
    ids = decode_ids(blocks)
    ends = np.cumsum(counts)
    return (
        [int(d) if k else None for d, k in zip(doc_ids, known)],
        [ids[e - c : e] for e, c in zip(ends, counts)],
    )


#: What a tokenizers file has to hold for ``PLAIN`` words to be single pieces.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Of bytes: letters of ASCII, signs of ASCII, all others.
LETTER, SIGN, OTHER = 1, 2, 4
KIND = np.full(256, OTHER, np.uint8)
KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = SIGN
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
#: Of the bytes behind 0xC3 that end a letter: the one of its lower case.
LOWER = np.zeros(256, np.uint8)
LOWER[0x80:0xC0] = [c | 0x20 for c in range(0x80, 0x9F)] + [*range(0x9F, 0xC0)]
LOWER[[0x97, 0xB7]] = 0  # multiplied, divided
#: The character that the library writes for each byte of lower-case letters and signs.
CHARACTER = np.arange(256, dtype="<u4")
CHARACTER[65:91] += 32
CHARACTER[[*range(0x80, 0xA1), 0xAD]] = np.arange(290, 324)


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``values`` starts (and the last ends) in their bytes, and these."""
    ends, data = offsets(values), values.buffers()[2]
    b = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    return ends - ends[0], b


class WordIds:
    """Ids of texts by a tokenizers file whose words never depend on the words
    beside them (white space is dropped, and letters never join the signs behind
    them): each distinct word is encoded by the library once.

    Where the file normalises and splits as ``NORMALIZER`` and ``SPLITTER`` say,
    a plain word (letters of ASCII and Latin-1, or signs of ASCII) is one piece
    that only becomes lower case: the library's model gets many of them in one
    text of lines, and the ends of words show in their last ids.  All other words
    go through the whole library, in batches balanced by bytes.
    """

    def __init__(self, vocabulary: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.dtype = np.uint16 if small else np.uint32
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = tuple(x.encode() for x in added)
        steps = json.loads(self.tokenizer.to_str())
        ids = self.tokenizer.get_vocab(with_added_tokens=False)
        suffix = steps["model"].get("end_of_word_suffix")
        letters = [chr(x) for x in sorted({*CHARACTER[33:].tolist()} - {127})]
        self.split = (
            (steps["normalizer"], steps["pre_tokenizer"]) == (NORMALIZER, SPLITTER)
            and bool(suffix)
            and all(x in ids and x + suffix in ids for x in letters)
            # an added token is no piece of the model
            and not self.plain(pack(list(self.whole))).any()
        )
        self.lines = Tokenizer(self.tokenizer.model)
        self.lines.pre_tokenizer = CharDelimiterSplit("\n")
        self.last = np.zeros(max(ids.values(), default=0) + 1, bool)  # ids that end a word
        self.last[[n for x, n in ids.items() if suffix and x.endswith(suffix)]] = True
        self.words = self.ids = pack([])  # those met, and the packed ids of each

    @staticmethod
    def plain(words: pa.Array) -> np.ndarray:
        """Which of ``words`` are letters of ASCII and Latin-1 or signs of ASCII."""
        ends, b = _bytes(words)
        if not len(b):
            return np.zeros(len(words), bool)
        kind = KIND[b]
        lead = np.flatnonzero(b[:-1] == 0xC3)
        lead = lead[LOWER[b[lead + 1]] > 0]
        kind[lead] = kind[lead + 1] = LETTER
        kind = np.bitwise_or.reduceat(np.append(kind, np.uint8(OTHER)), ends)[:-1]
        return ((kind == LETTER) | (kind == SIGN)) & (ends[1:] > ends[:-1])

    def encode_plain(self, words: pa.Array) -> pa.Array:
        """Packed ids of plain words."""
        ends, b = _bytes(words)
        line = np.full(len(b) + len(words), 10, np.uint8)
        within = np.ones(len(line), bool)
        ends = ends[1:] + np.arange(1, len(words) + 1)  # each word and a line's end
        within[ends - 1] = False
        line[within] = b
        text = CHARACTER[line]
        lead = np.flatnonzero(line[:-1] == 0xC3)
        text[lead + 1] = CHARACTER[LOWER[line[lead + 1]]]
        ids = []
        stops = [0, *ends[LINES - 1 : -1 : LINES].tolist(), *ends[-1:].tolist()]
        for i, j in zip(stops, stops[1:]):
            run = text[i : j - 1].tobytes().decode("utf-32-le")
            ids.append(np.array(self.lines.encode_batch_fast([run], add_special_tokens=False)[0].ids))
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        last = np.append(0, np.flatnonzero(self.last[ids]) + 1)
        if len(last) != len(words) + 1 or last[-1] != len(ids):
            raise RuntimeError("the ends of words do not show in their ids")
        return packed(last * self.dtype().itemsize, ids.astype(self.dtype))

    def encode_words(self, words: pa.Array) -> pa.Array:
        """Packed ids of each of ``words``."""
        plain = self.plain(words) if self.split else np.zeros(len(words), bool)
        mask = pa.array(plain)
        ids = self.encode_plain(words.filter(mask))
        if plain.all():
            return ids
        others = [x.decode() for x in words.filter(pc.invert(mask)).to_pylist()]
        place, packed_ids = {x: k for k, x in enumerate(others)}, [b""] * len(others)
        for run in balanced(others, BATCH_BYTES):
            encoded = self.tokenizer.encode_batch_fast(run, add_special_tokens=False)
            for word, x in zip(run, encoded):
                packed_ids[place[word]] = np.array(x.ids, self.dtype).tobytes()
        number = np.where(plain, np.cumsum(plain) - 1, np.cumsum(~plain) - 1 + len(ids))
        return pa.concat_arrays([ids, pack(packed_ids)]).take(pa.array(number))

    def encode(self, column: pa.Array, end: int) -> list[np.ndarray]:
        """Ids of each text of ``column``, then ``end``."""
        streams: list[np.ndarray] = []
        size = self.dtype().itemsize
        for texts in chunks(column, CUT_BYTES):
            if len(self.words) > KEPT_WORDS:  # what is met early is what is met often
                half = len(self.words) // 2
                self.words, self.ids = self.words.slice(0, half), self.ids.slice(0, half)
            cut = Units(texts, words=True, whole=self.whole)
            coded = pa.concat_arrays([self.words, cut.units]).dictionary_encode()
            new = coded.dictionary.slice(len(self.words))
            new_ids = self.encode_words(new)
            of_end = pack([np.array([end], self.dtype).tobytes()])
            values = pa.concat_arrays([self.ids, new_ids, of_end])
            number = coded.indices.to_numpy()[len(self.words) :]
            number = np.insert(number, cut.first[1:], len(values) - 1)
            kept = pa.array(np.diff(offsets(new)) <= LONG_UNIT)
            self.words = pa.concat_arrays([self.words, new.filter(kept)])
            self.ids = pa.concat_arrays([self.ids, new_ids.filter(kept)])
            ends, data = joined(values, number)
            ids = np.frombuffer(data, self.dtype)
            at = ends[cut.first + np.arange(len(cut.first))] // size
            streams += [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return streams


@lru_cache(maxsize=2)
def word_ids(vocabulary: str) -> WordIds:
    """One for each worker process: what it has met serves its later tasks too."""
    return WordIds(vocabulary)


def write_id_files(
    docs: DataFrame, vocabulary: str, end: int = 2, text_col: str = "text"
) -> DataFrame:
    """Encode whole texts and write their ids, in ascending doc_id order.

    The files lie in the shared folder as rows (part, seq, n_ids, segment):
    reading them in (part, seq) order gives the whole stream.  Each text's ids
    are followed by ``end``.  A null or empty text has the end id alone; null
    doc_ids come first; rows with equal doc_ids are ordered by a hash of their
    text, then by the text; an empty table gives no segments.
    """
    spark = docs.sparkSession
    conf = spark.conf.get("spark.sql.shuffle.partitions")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(vocabulary)
        part, seq = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        streams: list[np.ndarray] = []

        def flush():
            size = sum(map(len, streams))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([seq], pa.int32()),
                    pa.array([size], pa.int64()),
                    pa.array([pack_segment(names, streams)], pa.binary()),
                ],
                names=["part", "seq", "n_ids", "segment"],
            )

        waiting = 0
        for batch in batches:
            for start in range(0, batch.num_rows, AT_A_TIME):
                rows = batch.slice(start, AT_A_TIME)
                streams += words.encode(rows.column(1), end)
                names += rows.column(0).to_pylist()
                waiting += sum(map(len, streams[-rows.num_rows :]))
                if waiting >= SEGMENT_IDS:
                    yield flush()
                    names, streams = [], []
                    waiting, seq = 0, seq + 1
        if names:
            yield flush()

    ordered = (
        docs.select("doc_id", F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
        .repartitionByRange(int(conf), "doc_id", "hash")
        .sortWithinPartitions("doc_id", "hash", "text")
        .select("doc_id", "text")
    )
    coded = ordered.mapInArrow(segments, "part int, seq int, n_ids long, segment binary")
    return materialize(coded, "id-files")


def read_id_files(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents of ``write_id_files``: doc_id, start, n_tokens, ids_crc32, ids.

    Every block's checksum is verified.  ``start`` counts the ids of all
    documents before; ``ids`` is packed little-endian unsigned 32-bit (null
    without ``with_ids``: they are read and summed up, but not handed on).
    """

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                names, streams = unpack_segment(batch.column(2)[row].as_py())
                counts = np.array([len(s) for s in streams], np.int64)
                streams = [np.ascontiguousarray(s, "<u4") for s in streams]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[row].as_py()] * len(names), pa.int32()),
                        pa.array([batch.column(1)[row].as_py()] * len(names), pa.int32()),
                        pa.array(names, pa.int64()),
                        pa.array(np.cumsum(counts) - counts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array([zlib.crc32(x) for x in streams], pa.int64()),
                        pa.array([x.tobytes() for x in streams], pa.binary())
                        if with_ids
                        else pa.nulls(len(streams), pa.binary()),
                    ],
                    names=["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32", "ids"],
                )

    sizes = files.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each partition
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    starts = starts.join(parts, "part").select(
        "part", "seq", (F.col("ahead") + F.col("inside")).alias("before")
    )
    rows = files.select("part", "seq", "segment").mapInArrow(
        documents,
        "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long, ids binary",
    )
    return rows.join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "ids"
    )


def op5_mixing_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = write_id_files(
        read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )
    return read_id_files(files, with_ids=False).drop("ids")
