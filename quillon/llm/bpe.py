"""Byte-level BPE encoding by a hierarchical-bitmap rank queue, and decoding.

A pre-token is a linked list of parts.  Every possible merge is filed under
its rank: buckets by rank hold the list positions, and a two-level bitmap over
the ranks tells by find-first-set which rank is next.  A merge changes
two neighbours; their old entries stay in the buckets and are skipped when
they come up.  Each merge costs a few steps whatever the pre-token's length.

Short pre-tokens are merged many at a time: each is a lane with a queue of its
own, and one numpy operation takes the same step in all lanes.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import CACHES, lean, read_table
from .tokens import SPACE, forget_half
from .units import Cut, chunks, joined, offsets, packed

FAN = 8  # bits of a leaf of the bitmap: 256 ranks
KEPT_UNITS = 3 << 17  # units and pre-tokens whose ids a worker keeps before it forgets half of them
LONG_UNIT = 64  # longer units are encoded but not kept
LANES = 2048  # pre-tokens that are merged at a time
LANE_BYTES = 48  # longer pre-tokens have a queue of their own
TOP = 1 << 18  # ranks that a lane's bitmap can hold

_U = np.uint64
_MIX = _U(0x9E3779B97F4A7C15)


def _lowest(words: np.ndarray) -> np.ndarray:
    """Number of the lowest bit that is set in each word."""
    return np.bitwise_count(~words & (words - _U(1))).astype(np.int64)


class Pairs:
    """A hash table from two neighbouring parts to the rank of their merge."""

    def __init__(self, pair: dict[int, int]):
        keys = np.fromiter(pair.keys(), _U, len(pair))
        ranks = np.fromiter(pair.values(), np.int32, len(pair))
        self.shift = _U(64 - max(4, (4 * len(pair)).bit_length()))
        slots = 1 << 64 - int(self.shift)
        self.keys, self.ranks = np.full(slots, _U(2**64 - 1)), np.full(slots, -1, np.int32)
        at = self.slot(keys)
        self.tries = 0
        while len(keys):  # what finds its slot taken tries the next
            self.tries += 1
            free = np.flatnonzero(self.ranks[at] < 0)
            first = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[first]], self.ranks[at[first]] = keys[first], ranks[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks, at = keys[rest], ranks[rest], (at[rest] + 1) & (slots - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, or -1 where the two make no token."""
        keys = left.astype(_U) << _U(32) | right.astype(_U)
        at = self.slot(keys)
        found = self.ranks[at]
        other = np.flatnonzero((self.keys[at] != keys) & (found >= 0))
        found[other] = -1
        for step in range(1, self.tries):
            if not len(other):
                break
            at = (self.slot(keys[other]) + step) & (len(self.keys) - 1)
            ranks = self.ranks[at]
            hit = self.keys[at] == keys[other]
            found[other[hit]] = ranks[hit]
            other = other[~hit & (ranks >= 0)]
        return found


class Lanes:
    """Queues of many pre-tokens: for each a bitmap over the ranks in three
    levels of 64-bit words.  A bit tells that the rank waits somewhere in the
    pre-token; where, its positions' ``filed`` ranks tell."""

    def __init__(self, bpe: ByteBPE):
        self.none = bpe.top + 1  # what stands around a pre-token
        self.pairs = Pairs(bpe.pair)
        self.single = np.array(bpe.single)
        self.leaf = np.zeros((LANES, (self.none >> 6) + 1), _U)
        self.mid = np.zeros((LANES, (self.none >> 12) + 1), _U)
        self.root = np.zeros(LANES, _U)

    def file(self, lane: np.ndarray, rank: np.ndarray) -> None:
        """One rank of each lane joins its queue, or -1: none."""
        some = np.flatnonzero(rank >= 0)
        lane, rank = lane[some], rank[some].astype(_U)
        for level, by in ((self.leaf, 0), (self.mid, 6)):
            level[lane, (rank >> _U(by + 6)).astype(np.int64)] |= _U(1) << (rank >> _U(by) & _U(63))
        self.root[lane] |= _U(1) << (rank >> _U(12))

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of at most LANES pre-tokens, one behind the other, and how many each has."""
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        lanes, width = len(n), int(n.max())
        text = np.frombuffer(b"".join([x.ljust(width, b"\0") for x in pieces]), np.uint8)
        ids = np.full((lanes, width + 2), self.none, np.int64)
        own = np.arange(width) < n[:, None]
        ids[:, 1:-1] = np.where(own, self.single[text.reshape(lanes, width)], self.none)
        after = np.tile(np.arange(1, width + 3), (lanes, 1))
        before = after - 2
        filed = np.full((lanes, width + 2), -1, np.int32)
        filed[:, :-1] = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(lanes, -1)
        part = np.zeros((lanes, width + 2), bool)
        part[:, 1:-1] = own
        live = np.arange(lanes)
        for column in range(1, width):
            self.file(live, filed[:, column])
        while len(live := live[self.root[live] != 0]):
            root = self.root[live]
            at_mid = _lowest(root)
            mid = self.mid[live, at_mid]
            at_leaf = at_mid << 6 | _lowest(mid)
            leaf = self.leaf[live, at_leaf]
            rank = at_leaf << 6 | _lowest(leaf)
            waits = filed[live] == rank[:, None].astype(np.int32)
            i = waits.argmax(axis=1)  # equal ranks merge from the left
            count = np.count_nonzero(waits, axis=1)
            gone = np.flatnonzero(count < 2)
            lane, leaf = live[gone], leaf[gone] & (leaf[gone] - _U(1))
            self.leaf[lane, at_leaf[gone]] = leaf
            gone = gone[leaf == 0]
            lane, mid = live[gone], mid[gone] & (mid[gone] - _U(1))
            self.mid[lane, at_mid[gone]] = mid
            gone = gone[mid == 0]
            self.root[live[gone]] = root[gone] & (root[gone] - _U(1))
            hit = count > 0  # else stale
            lane, i, rank = live[hit], i[hit], rank[hit]
            j = after[lane, i]
            k = after[lane, j]
            p = before[lane, i]
            after[lane, i] = k
            before[lane, k] = i
            ids[lane, i] = rank
            part[lane, j] = False
            filed[lane, j] = -1
            both = self.pairs.find(
                np.concatenate([ids[lane, p], rank]), np.concatenate([rank, ids[lane, k]])
            )
            left, right = both[: len(lane)], both[len(lane) :]
            filed[lane, p], filed[lane, i] = left, right
            self.file(lane, left)
            self.file(lane, right)
        return ids[part].astype(np.uint32), np.count_nonzero(part, axis=1)


class ByteBPE:
    """Encoder and decoder for a table of token bytes and ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.top = max(self.bytes_of)
        self.single = [ranks[bytes([b])] for b in range(256)]
        #: two neighbouring parts -> rank of the token that they make
        self.pair = {
            left << 32 | right: rank
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if (left := ranks.get(token[:cut])) is not None
            and (right := ranks.get(token[cut:])) is not None
        }

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token.

        ``buckets`` hold, for each rank, a heap of the positions whose merge
        waits; ``leaves`` and ``root`` are the bitmaps that tell which ranks
        have a bucket.  ``filed`` is the rank that a position waits under now:
        an entry of a bucket that disagrees is stale and skipped.
        """
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        rank_of = self.pair.get
        ids = [self.single[b] for b in piece]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        filed: list[int | None] = [None] * n
        buckets: dict[int, list[int]] = {}
        leaves: dict[int, int] = {}
        root = 0

        for i in range(n - 1):
            rank = rank_of(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                filed[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)  # positions rise: still a heap
                else:
                    buckets[rank] = [i]
                    leaf = rank >> FAN
                    leaves[leaf] = leaves.get(leaf, 0) | 1 << (rank & 255)
                    root |= 1 << leaf
        while root:
            leaf = (root & -root).bit_length() - 1
            ranks = leaves[leaf]
            low = ranks & -ranks
            rank = leaf << FAN | low.bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)  # equal ranks merge from the left
            if not bucket:
                del buckets[rank]
                if ranks == low:
                    del leaves[leaf]
                    root &= root - 1
                else:
                    leaves[leaf] = ranks ^ low
            if filed[i] != rank:
                continue  # stale
            j = after[i]
            k = after[i] = after[j]
            ids[i] = rank
            filed[j] = None
            p = before[i]
            if k < n:
                before[k] = i
                right = rank_of(rank << 32 | ids[k])
            else:
                right = None
            left = rank_of(ids[p] << 32 | rank) if p >= 0 else None
            if p >= 0:
                filed[p] = left
            filed[i] = right
            for new, position in ((left, p), (right, i)):
                if new is None:
                    continue
                if new in buckets:
                    heappush(buckets[new], position)
                else:
                    buckets[new] = [position]
                    leaf = new >> FAN
                    leaves[leaf] = leaves.get(leaf, 0) | 1 << (new & 255)
                    root |= 1 << leaf
        out = []
        i = 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each of some distinct pre-tokens."""
        out: dict[bytes, bytes] = {}
        rest = []
        for piece in pieces:
            whole = self.ranks.get(piece)
            if whole is not None:
                out[piece] = array("I", [whole]).tobytes()
            elif len(piece) > LANE_BYTES or self.top >= TOP:
                out[piece] = array("I", self.encode_piece(piece)).tobytes()
            else:
                rest.append(piece)
        rest.sort(key=len)  # lanes of like length
        for start in range(0, len(rest), LANES):
            some = rest[start : start + LANES]
            ids, counts = self.lanes.encode(some)
            data, ends = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
            out.update((x, data[a:b]) for x, a, b in zip(some, [0, *ends], ends))
        return [out[x] for x in pieces]

    @cached_property
    def lanes(self) -> Lanes:
        return Lanes(self)

    @cached_property
    def tokens(self) -> pa.Array:
        """Bytes of each id."""
        known = [self.bytes_of.get(r, b"") for r in range(self.top + 1)]
        return pa.array(known, pa.binary())

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(read_ranks(path))


class TextEncoder:
    """Texts to packed ids; units met before are looked up.

    The pattern's matches never cross from one unit of ``Cut`` to the next.
    """

    def __init__(self, vocabulary: str, pattern: str):
        import regex

        self.bpe = load(vocabulary)
        # white space as the tiktoken library has it
        pattern = pattern.replace(r"[^\s", f"[^{SPACE}")
        pattern = pattern.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
        self.split = regex.compile(pattern).findall
        self.known: dict[bytes, bytes] = {}

    def learn(self, units: list[bytes]) -> dict[bytes, bytes]:
        """Packed ids of units that are not known yet; their pre-tokens may be.
        Short ones are known from here on, the others are returned."""
        known, long_ = self.known, {}
        pieces = [[x.encode() for x in self.split(u.decode())] for u in units]
        new = [x for x in dict.fromkeys(chain.from_iterable(pieces)) if x not in known]
        for piece, ids in zip(new, self.bpe.encode_pieces(new)):
            (known if len(piece) <= LONG_UNIT else long_)[piece] = ids
        for unit, own in zip(units, pieces):
            if len(own) > 1:
                ids = b"".join([known[x] if x in known else long_[x] for x in own])
                (known if len(unit) <= LONG_UNIT else long_)[unit] = ids
        return long_

    def encode_column(self, texts: pa.Array) -> pa.Array:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        known = self.known
        forget_half(known, KEPT_UNITS)
        cut = Cut(texts)
        long_ = self.learn([u for u in cut.distinct if u not in known])
        if long_:
            ids_of = [known[u] if u in known else long_[u] for u in cut.distinct]
        else:
            ids_of = list(map(known.__getitem__, cut.distinct))
        ends, data = joined(ids_of, cut.number)
        return packed(ends[cut.first], data)

    def decode_column(self, ids: pa.Array) -> pa.Array:
        """Bytes of each row of ``encode_column``."""
        flat = pa.Array.from_buffers(pa.uint32(), ids.buffers()[2].size // 4, [None, ids.buffers()[2]])
        decoded = self.bpe.tokens.take(flat)
        return packed(offsets(decoded)[offsets(ids) // 4], decoded.buffers()[2] or b"")

    def encode(self, text: str) -> bytes:
        """Ids of one text."""
        return b"".join(self.encode_column(x)[0].as_py() for x in chunks(pa.array([text])))


@lru_cache(maxsize=2)
def text_encoder(vocabulary: str, pattern: str) -> TextEncoder:
    """One for each worker process: what it has met serves its later tasks too."""
    return TextEncoder(vocabulary, pattern)


CACHES += [load, text_encoder]


def encode_texts(
    docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", decode: bool = True
) -> DataFrame:
    """Encode whole texts of ``docs`` and, with ``decode``, decode the ids again.

    Returns doc_id, ids (packed little-endian unsigned 32-bit integers) and
    decoded (bytes, else null).  A null text is an empty one; an empty text has no ids;
    repeated rows each give a row; an empty table gives an empty result; other
    columns are not read.
    """

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(vocabulary, pattern)
        for batch in batches:
            start = 0
            for texts in chunks(batch.column(1)):
                ids = encoder.encode_column(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(texts)),
                        ids,
                        encoder.decode_column(ids) if decode else pa.nulls(len(ids), pa.binary()),
                    ],
                    names=["doc_id", "ids", "decoded"],
                )
                start += len(texts)

    return docs.select("doc_id", text_col).mapInArrow(
        lean(both, __name__), "doc_id long, ids binary, decoded binary"
    )


def digests(encoded: DataFrame) -> DataFrame:
    """What the query returns of ``encode_texts``."""
    return encoded.selectExpr(
        "doc_id",
        "cast(octet_length(ids) div 4 as bigint) AS n_tokens",
        "sha2(ids, 256) AS ids_sha256",
        "sha2(decoded, 256) AS decoded_sha256",
    )


def op9_bitmap_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(
        encode_texts(
            read_table(spark, sf_dir, "documents"),
            public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
            public_tokenizers.PATTERN,
        )
    )
