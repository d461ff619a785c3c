"""N-gram Jaccard join with adaptive multi-match prefixes.

Each text is the set of its word shingles.  All sets are read in one global
order (rare shingles first), and two sets that are similar enough must share
at least l shingles within their l-prefixes, for every l.  Each document picks
its own l by the candidates it must expect: where its prefix holds frequent
shingles, a longer prefix with more required matches is cheaper than
verifying every document that shares one of them.  Pairs that meet their l
are verified on the whole sets.

Equal texts are one node from the start, equal sets are linked by a line for
each text, and before the join every set is verified against the leaders of its
smallest hashes.  The links found so join large groups of copies by a line for
each member; the join then looks for links between different components only,
so no group is expanded into all its pairs and no link between components is
lost.

Matches on very frequent shingles stand last in the order.  A pair that shares
an earlier shingle is found there; any other pair must share all its matches
among the very frequent ones, and a bitmap of these that each posting carries
bounds how many they can be.  So a passage in very many documents hands on the
pairs that may be similar, not every pair that holds it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, drop_table, lean, materialize, read_table

CELL_BITS = 22  # counters of the frequency sketch
SLABS = 64  # parts in which sketches are added up
MOST_MATCHES = 4  # largest l
BITMAP_BITS = 22
GRID = 8192  # postings of a frequent shingle that meet in one task
HOT_RANK = 6  # shingles of cells with 32 documents or more are very frequent
HOT_WORDS = 4  # 64-bit words of the bitmap of a document's very frequent prefix shingles
LEADERS = 4  # smallest hashes by which a document looks for leaders
KEPT_TEXTS = 1 << 18  # hashes of texts that a task keeps to tell repeated ones
PAIRS_AT_ONCE = 1 << 18  # pairs of postings that are compared at a time
AT_ONCE = 1 << 20  # bytes of text, and shingles, that are worked on at a time
_MIX = np.uint64(0x9FB21C651E98DF25)
_S = np.uint64(32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S)) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> _S)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


#: What each byte adds to the hash of its word; A-Z as a-z, white space ends words.
_CODE = _mix(np.arange(1, 257, dtype=np.uint64))
_CODE[ord("A") : ord("Z") + 1] = _CODE[ord("a") : ord("z") + 1]
_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False
_BASE = 0xD6E8FEB86659FD93


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts.

    Words are hashed without being taken out of their texts: the hash is a
    polynomial of the word's bytes, a difference of running sums over the text."""

    def __init__(self, size: int):
        self.size = size
        self.factors = _mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
        self.up = _powers(_BASE, AT_ONCE)
        self.down = _powers(pow(_BASE, -1, 1 << 64), AT_ONCE)

    def _words(self, data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and first bytes of the words in at most AT_ONCE bytes; a word
        ends at white space and before each of ``breaks``."""
        n = len(data)
        solid = _SOLID[data]
        before, after = np.r_[False, solid[:-1]], np.r_[solid[1:], False]
        breaks = breaks[(breaks > 0) & (breaks < n)]
        before[breaks] = False
        after[breaks - 1] = False
        first = np.flatnonzero(solid & ~before)
        last = np.flatnonzero(solid & ~after)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODE[data] * self.up[:n], out=sums[1:])
        return _mix((sums[last + 1] - sums[first]) * self.down[first]), first

    def _long(self, data: np.ndarray) -> np.ndarray:
        """Hashes of the words of a text of any length."""
        out, at = [], 0
        while at < len(data):
            end = min(len(data), at + AT_ONCE)
            if end < len(data):
                blank = np.flatnonzero(~_SOLID[data[at:end]])
                if len(blank):
                    end = at + int(blank[-1]) + 1
                else:  # a word of AT_ONCE bytes or more
                    rest = np.flatnonzero(~_SOLID[data[end:]])
                    end = end + int(rest[0]) if len(rest) else len(data)
            if end - at < AT_ONCE or not _SOLID[data[at:end]].all():
                out.append(self._words(data[at:end], np.zeros(0, np.int64))[0])
            else:
                word = xxhash.xxh3_64_intdigest(data[at:end].tobytes().lower())
                out.append(np.array([word], np.uint64))
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def _windows(self, h: np.ndarray, width: int) -> np.ndarray:
        total = np.full(max(0, len(h) - width + 1), width, np.uint64)
        for k in range(width):
            total += h[k : len(total) + k] * self.factors[k]
        return _mix(total)

    def _set(self, windows: np.ndarray) -> np.ndarray:
        s = np.sort(windows)
        return s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s

    def _parts(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, list[int]]]:
        """Word hashes of some texts at a time, and where each text's begin."""
        texts = texts.cast(pa.large_binary())
        n = len(texts)
        if not n:
            return
        if texts.null_count:  # null texts may have bytes below them
            texts = texts.fill_null(b"")
        edges = np.frombuffer(texts.buffers()[1], np.int64, n + 1, 8 * texts.offset)
        buffer = texts.buffers()[2]
        data = np.frombuffer(buffer, np.uint8) if buffer else np.zeros(0, np.uint8)
        row = 0
        while row < n:
            end = max(row + 1, int(np.searchsorted(edges, edges[row] + AT_ONCE, "right")) - 1)
            part = data[edges[row] : edges[end]]
            starts = edges[row:end] - edges[row]
            if len(part) > AT_ONCE:
                h = self._long(part)
                yield h, [0, len(h)]
            else:
                h, first = self._words(part, starts)
                yield h, [*np.searchsorted(first, starts).tolist(), len(h)]
            row = end

    def word_hashes(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Hashes of the words of each text, in order."""
        for h, at in self._parts(texts):
            for a, b in zip(at, at[1:]):
                yield h[a:b]

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The set of each text, in order; null and empty texts have none."""
        for h, at in self._parts(texts):
            whole = self._windows(h, self.size)
            for a, b in zip(at, at[1:]):
                if b - a >= self.size:
                    yield self._set(whole[a : b - self.size + 1])
                elif a < b:  # a short text is one shingle
                    yield self._windows(h[a:b], b - a)
                else:
                    yield np.zeros(0, np.uint64)

    def __call__(self, text: bytes | None) -> np.ndarray:
        return next(self.sets(pa.array([text], pa.binary())))


@dataclass(frozen=True)
class Similarity:
    """Jaccard similarity of at least ``num`` / ``den``, in whole numbers."""

    num: int
    den: int

    def least_probe(self, n):
        """Shared shingles of a set of n with any similar set that is not larger."""
        return -(-self.num * n // self.den)

    def least_index(self, n):
        """The same with any similar set that is not smaller."""
        return -(-2 * self.num * n // (self.den + self.num))

    def least_pair(self, n, m):
        return -(-self.num * (n + m) // (self.den + self.num))

    def holds(self, a: np.ndarray, b: np.ndarray) -> bool:
        if self.den * min(len(a), len(b)) < self.num * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return self.den * both >= self.num * (len(a) + len(b) - both)


SETS = "kind int, doc_id long, t long, n long, d1 long, d2 long, data binary"


def _read_sets(size: int):
    """One pass over the texts: a row for each document, and the sketch.

    kind 0: doc_id, t (the text's hash), n and digest (d1, d2);
    kind 1: slab number and its packed counters."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(size)
        cells = np.zeros(1 << CELL_BITS, np.uint32)
        shift = np.uint64(64 - CELL_BITS)
        waiting, size_ = [], 0

        def add(parts):
            at = np.sort(np.concatenate(parts))
            edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            cells[at[edge]] += np.diff(np.r_[edge, len(at)]).astype(np.uint32)

        for batch in batches:
            n_, d1, d2 = [], [], []
            for s in shingles.sets(batch.column(2)):
                n_.append(len(s))
                data = s.tobytes()
                d1.append(xxhash.xxh3_64_intdigest(data) - (1 << 63))
                d2.append(zlib.crc32(data))
                waiting.append((s >> shift).astype(np.uint32))
                size_ += len(s)
                if size_ >= AT_ONCE:
                    add(waiting)
                    waiting, size_ = [], 0
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(rows, np.int32)),
                    batch.column(0),
                    batch.column(1),
                    pa.array(n_, pa.int64()),
                    pa.array(d1, pa.int64()),
                    pa.array(d2, pa.int64()),
                    pa.nulls(rows, pa.binary()),
                ],
                names=SETS.replace(",", "").split()[::2],
            )
        if size_:
            add(waiting)
        slab = len(cells) // SLABS
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.ones(SLABS, np.int32)),
                pa.array(np.arange(SLABS)),
                *[pa.nulls(SLABS, pa.int64())] * 4,
                pa.array(
                    [zlib.compress(cells[k * slab : (k + 1) * slab].tobytes(), 1) for k in range(SLABS)],
                    pa.binary(),
                ),
            ],
            names=SETS.replace(",", "").split()[::2],
        )

    return read


def _add_slabs(slabs):
    import pandas as pd

    total = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.int64) for x in slabs["data"])
    return pd.DataFrame(
        {"slab": [slabs["doc_id"].iloc[0]], "total": [int(total.sum())], "data": [zlib.compress(total.tobytes(), 1)]}
    )


def frequent_cells(sketch: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the sketch far above the mean, and their counts.

    The sketch counts every shingle of every document; it has a fixed number
    of cells, so what comes to the driver does not grow with the input."""
    slabs = materialize(
        sketch.groupBy("doc_id").applyInPandas(_add_slabs, "slab long, total long, data binary"), "sketch"
    )
    mean = (slabs.agg(F.sum("total")).head()[0] or 0) / (1 << CELL_BITS)
    bound, size = mean + 6 * np.sqrt(mean) + 16, (1 << CELL_BITS) // SLABS

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab, data in zip(batch.column(0).to_pylist(), batch.column(2)):
                counts = np.frombuffer(zlib.decompress(data.as_py()), np.int64)
                at = np.flatnonzero(counts > bound)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slab * size + at, pa.int64()), pa.array(counts[at])], names=["cell", "n"]
                )

    found = slabs.mapInArrow(lean(above), "cell long, n long").toArrow()
    drop_table(slabs)
    cells, counts = (found.column(k).to_numpy() for k in (0, 1))
    order = np.argsort(cells)
    return cells[order], counts[order]


PREFIXES = "t long, n long, l int, cool int, prefix binary, low binary, ordinary long"


class _Seen(set):
    """Texts that a task has met lately: what it need not hand on again."""

    def new(self, t: int) -> bool:
        if t in self:
            return False
        if len(self) >= KEPT_TEXTS:
            self.clear()
        self.add(t)
        return True


def _prefixes(size: int, like: Similarity, hot: np.ndarray, counts: np.ndarray):
    """Each text's longest prefix in the global order, its chosen l, how many
    shingles of the prefix are not very frequent (``cool``), its LEADERS smallest
    hashes and the number of its shingles in ordinary cells.

    The order: shingles of ordinary cells by hash, then those of frequent
    cells by the logarithm of the count, then hash.  A task hands on a repeated
    text once as a rule."""
    shift = np.uint64(64 - CELL_BITS)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingler(size), _Seen()
        count_of = np.zeros(1 << CELL_BITS, np.int64)
        count_of[hot] = counts
        rank_of = np.zeros(1 << CELL_BITS, np.int8)
        rank_of[hot] = np.log2(np.maximum(counts, 1)).astype(np.int8) + 1
        for batch in batches:
            columns = [[] for _ in range(7)]
            batch = batch.filter(pa.array([seen.new(t) for t in batch.column(0).to_pylist()], pa.bool_()))
            for t, s in zip(batch.column(0).to_pylist(), shingles.sets(batch.column(1))):
                n = len(s)
                if not n:
                    continue
                cell = (s >> shift).astype(np.int64)
                order = np.argsort(rank_of[cell], kind="stable")
                least = like.least_probe(n)
                most = min(MOST_MATCHES, least)
                order = order[: n - least + most]
                expected = np.maximum(count_of[cell[order]] - 1, 0)
                # lists read, and candidates that reach l matches (at most sum / l)
                cost = [
                    n - least + l + expected[: n - least + l].sum() * (1 + 50 / l)
                    for l in range(1, most + 1)
                ]
                grid = np.maximum(1, -(-count_of[cell[order]] // GRID))
                own = (
                    t,
                    n,
                    int(np.argmin(cost)) + 1,
                    int((rank_of[cell[order]] < HOT_RANK).sum()),
                    s[order].tobytes() + grid.astype("<u4").tobytes(),
                    s[:LEADERS].tobytes(),
                    int((rank_of[cell] == 0).sum()),
                )
                for column, value in zip(columns, own):
                    column.append(value)
            kinds = pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)],
                names=PREFIXES.replace(",", "").split()[::2],
            )

    return prefixes


_HOT_BITS = [f"h{k}" for k in range(HOT_WORDS)]
POSTING = (
    "key long, id long, component long, n int, place int, l int, role int, cool int, length int, "
    + ", ".join(f"{x} long" for x in _HOT_BITS)
)
POSTING_NAMES = POSTING.replace(",", "").split()[::2]


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    """HOT_WORDS words with a bit for each of some shingles."""
    bit = (_mix(hashes) >> np.uint64(8)) % np.uint64(64 * HOT_WORDS)
    out = np.zeros(HOT_WORDS, np.uint64)
    np.bitwise_or.at(out, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out.view(np.int64)


def _postings(like: Similarity):
    """One row for each prefix shingle; those of frequent ones in a grid.

    In the grid of a frequent shingle a document stands in one row of cells
    for its larger role (bit 1) and one column for its smaller role (bit 2):
    any two documents meet in exactly one cell for each pair of roles.  Rows of
    very frequent shingles carry the bitmap of all of these in the prefix, and
    stand only where the first of a pair's matches can be."""
    kinds = [pa.int64()] * 3 + [pa.int32()] * 6 + [pa.int64()] * HOT_WORDS

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                out = [[] for _ in kinds]
                ids, ns, ls, cools, comps = (
                    part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 3, 5)
                )
                for k in range(part.num_rows):
                    data = part.column(4)[k].as_py()
                    m, n, cool = len(data) // 12, int(ns[k]), int(cools[k])
                    keys = np.frombuffer(data, np.uint64, m)
                    grid = np.frombuffer(data, "<u4", m, 8 * m).astype(np.int64)
                    bits = _bitmap(keys[cool:])
                    places = np.arange(m)
                    hot = places >= cool
                    role = np.where(hot & (places > n - like.least_probe(n)), 0, 1)
                    role |= np.where(hot & (places > n - like.least_index(n)), 0, 2)
                    there = role > 0
                    keys, grid, places, role = keys[there], grid[there], places[there], role[there]
                    wide = np.flatnonzero(grid > 1)
                    if len(wide):
                        narrow = np.flatnonzero(grid == 1)
                        more = [(keys[narrow], places[narrow], role[narrow])]
                        own = zlib.crc32(int(ids[k]).to_bytes(8, "little", signed=True))
                        for w in wide:
                            g = int(grid[w])
                            across = np.arange(g, dtype=np.uint64)
                            mine, side = np.uint64(own % g), np.uint64(g)
                            for bit, cell in ((1, mine * side + across), (2, across * side + mine)):
                                if role[w] & bit:
                                    more.append(
                                        (
                                            _mix(keys[w] + (cell + np.uint64(1)) * _MIX),
                                            np.full(g, places[w]),
                                            np.full(g, bit),
                                        )
                                    )
                        keys, places, role = (np.concatenate(x) for x in zip(*more))
                    size = len(keys)
                    hot = places >= cool
                    row = [
                        keys.view(np.int64),
                        *(np.full(size, x) for x in (ids[k], comps[k], n)),
                        places,
                        np.full(size, ls[k]),
                        role,
                        *(np.full(size, x) for x in (cool, m)),
                        *(np.where(hot, x, 0) for x in bits),
                    ]
                    for column, value in zip(out, row):
                        column.append(value)
                if out[0]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(c), t) for c, t in zip(out, kinds)],
                        names=POSTING_NAMES,
                    )

    return postings


MATCHES = "x long, y long, l int, hits int, later int, rest_x int, rest_y int, need int"


def _meet(like: Similarity):
    """Postings sorted by key to matches (larger, smaller, l), with what is left
    of either set behind the match and what the pair needs to share.

    ``hits`` counts towards l: one for a match, l for a match among the very
    frequent shingles, whose bitmaps have told that the pair may reach l there;
    ``later`` bounds the matches among these for a pair that is found before."""

    def candidates(a: np.ndarray, b: np.ndarray, c: dict[str, np.ndarray]) -> np.ndarray:
        """Which of the row pairs (a larger, b smaller) may be similar."""
        n, m = c["n"][a], c["n"][b]
        fits = (c["role"][a] & 1 > 0) & (c["role"][b] & 2 > 0)
        fits &= (n > m) | ((n == m) & (c["id"][a] > c["id"][b]))
        fits &= c["component"][a] != c["component"][b]
        fits &= like.den * m >= like.num * n
        left = np.flatnonzero(fits)
        a, b, n, m = a[left], b[left], n[left], m[left]
        p, r, l, need = c["place"][a], c["place"][b], c["l"][a], like.least_pair(n, m)
        hot = p >= c["cool"][a]
        # similar sets share l shingles, the first of them one, this near the front
        reach = np.where(hot, 1, l)
        ok = (p < n - need + reach) & (r < m - need + reach)
        # what may be shared before, here and after this shingle
        ok &= np.minimum(p, r) + np.minimum(n - p, m - r) >= need
        hot = np.flatnonzero(hot & ok)
        a, b, n, m = a[hot], b[hot], n[hot], m[hot]
        shared, alone_a, alone_b = (np.zeros(len(hot), np.int64) for _ in range(3))
        for word in _HOT_BITS:
            x, y = c[word][a].view(np.uint64), c[word][b].view(np.uint64)
            shared += np.bitwise_count(x & y)
            alone_a += np.bitwise_count(x)
            alone_b += np.bitwise_count(y)
        # shingles that fell on one bit may be shared too
        shared += np.minimum(
            c["length"][a] - c["cool"][a] - alone_a, c["length"][b] - c["cool"][b] - alone_b
        )
        beyond = np.maximum(n - c["length"][a], m - c["length"][b])
        ok[hot] = (shared >= l[hot]) & (shared + beyond >= need[hot])
        return left[ok]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(parts):
            t = pa.Table.from_batches(parts)
            c = {x: t.column(x).to_numpy().astype(np.int64) for x in POSTING_NAMES}
            key = c["key"]
            edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            length = np.diff(edge)
            found = []
            for size in np.unique(length[length > 1]):
                first = edge[:-1][length == size]
                if size <= 24:
                    i, j = np.nonzero(~np.eye(size, dtype=bool))
                    step = max(1, PAIRS_AT_ONCE // len(i))
                    for k in range(0, len(first), step):
                        a = (first[k : k + step, None] + i).ravel()
                        b = (first[k : k + step, None] + j).ravel()
                        ok = candidates(a, b, c)
                        found.append((a[ok], b[ok]))
                else:
                    for f in first:
                        every = np.arange(f, f + size)
                        if (c["component"][every] == c["component"][f]).all():
                            continue
                        for k in range(0, size, max(1, PAIRS_AT_ONCE // size)):
                            own = every[k : k + max(1, PAIRS_AT_ONCE // size)]
                            a, b = np.repeat(own, size), np.tile(every, len(own))
                            ok = candidates(a, b, c)
                            found.append((a[ok], b[ok]))
            if found:
                a, b = (np.concatenate(x) for x in zip(*found))
                n, m, l = c["n"][a], c["n"][b], c["l"][a]
                hot = c["place"][a] >= c["cool"][a]
                later = np.minimum(c["length"][a] - c["cool"][a], c["length"][b] - c["cool"][b])
                out = [
                    c["id"][a],
                    c["id"][b],
                    l,
                    np.where(hot, l, 1),
                    later,
                    n - c["place"][a] - 1,
                    m - c["place"][b] - 1,
                    like.least_pair(n, m),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64() if k < 2 else pa.int32()) for k, x in enumerate(out)],
                    names=MATCHES.replace(",", "").split()[::2],
                )

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if held and held[-1].column(0)[-1].as_py() != key[0]:
                yield from pairs(held)
                held = []
            if cut:
                yield from pairs([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from pairs(held)

    return meet


def _profile(s: np.ndarray) -> bytes:
    """Shingles in each of some equal ranges of hash values, about four a range."""
    bits = min(16, max(3, int(np.ceil(np.log2(max(len(s), 1) / 4)))))
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype("<u2").tobytes()


def _most_shared(a: bytes, b: bytes) -> tuple[int, int, int]:
    """Sizes of two sets, and a bound on what they share, by their profiles."""
    x = np.frombuffer(a, "<u2").astype(np.int64)
    y = np.frombuffer(b, "<u2").astype(np.int64)
    n, m = int(x.sum()), int(y.sum())
    if len(x) > len(y):
        x = x.reshape(len(y), -1).sum(axis=1)
    elif len(y) > len(x):
        y = y.reshape(len(x), -1).sum(axis=1)
    return n, m, int(np.minimum(x, y).sum())


def _id_bitmap(pairs: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over the ids in ``pairs``: no id is missed."""
    words = (
        pairs.select(F.explode(F.array("x", "y")).alias("id"))
        .select(F.pmod("id", F.lit(1 << BITMAP_BITS)).alias("bit"))
        .groupBy(F.shiftright("bit", 5).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("bits"))
        .toArrow()  # at most 2^17 words
    )
    bitmap = np.zeros(1 << (BITMAP_BITS - 5), np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    return bitmap


def _in_bitmap(bitmap: np.ndarray, at: pa.Array) -> pa.Array:
    at = at.to_numpy(zero_copy_only=False)
    return pa.array((bitmap[at >> 5] >> (at & 31)) & 1 > 0)


def verify_pairs(texts: DataFrame, pairs: DataFrame, size: int, like: Similarity) -> DataFrame:
    """Those of ``pairs`` (x, y) whose whole sets are similar, as links (a, b).

    ``texts`` has t, the text's hash by which pairs name it, and text.  First
    the sets' profiles are compared, which bound what two sets share and are
    much smaller than texts; only the texts of pairs that may still be similar
    travel, and their whole sets are compared.  Tables are written before they
    are joined, so that Spark can split the join where one text has very many
    pairs."""
    place = F.pmod("t", F.lit(1 << BITMAP_BITS)).alias("place")
    bitmap = _id_bitmap(pairs)

    def involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingler(size), _Seen()
        for batch in batches:
            part = batch.filter(_in_bitmap(bitmap, batch.column(2)))
            part = part.filter(pa.array([seen.new(t) for t in part.column(0).to_pylist()], pa.bool_()))
            profiles = [_profile(s) for s in shingles.sets(part.column(1))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(profiles, pa.binary())], names=["t", "profile"]
            )

    profiles = materialize(
        texts.select("t", "text", place).mapInArrow(lean(involved), "t long, profile binary").dropDuplicates(["t"]),
        "profiles",
    )

    def rough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                n, m, most = _most_shared(a.as_py(), b.as_py())
                keep.append(most >= like.least_pair(n, m))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    close = materialize(
        pairs.join(profiles.toDF("x", "px"), "x")
        .join(profiles.toDF("y", "py"), "y")
        .select("x", "y", "px", "py")
        .mapInArrow(lean(rough), "x long, y long"),
        "close-pairs",
    )
    drop_table(profiles)
    near = _id_bitmap(close)

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            part = batch.select([0, 1]).filter(_in_bitmap(near, batch.column(2)))
            yield part.filter(pa.array([seen.new(t) for t in part.column(0).to_pylist()], pa.bool_()))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(size)
        for batch in batches:
            a, b = [], []
            names = batch.column(1).to_pylist()
            new = [k == 0 or y != names[k - 1] for k, y in enumerate(names)]
            others = shingles.sets(batch.column(3).filter(pa.array(new, pa.bool_())))
            rows = zip(batch.column(0).to_pylist(), names, new, shingles.sets(batch.column(2)))
            for x, y, turn, s in rows:
                own = next(others) if turn else own
                if like.holds(s, own):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]
            )

    whole = materialize(
        texts.select("t", "text", place).mapInArrow(lean(needed), "t long, text string").dropDuplicates(["t"]),
        "pair-texts",
    )
    joined = (
        close.join(whole.toDF("x", "tx"), "x")
        .join(whole.toDF("y", "ty"), "y")
        .select("x", "y", "tx", "ty")
    )
    links = materialize(joined.mapInArrow(lean(check), "a long, b long"), "pair-links")
    drop_table(whole)
    drop_table(close)
    return links


def jaccard_components(
    docs: DataFrame, size: int = 5, num: int = 8, den: int = 10
) -> DataFrame:
    """Near-duplicate classes of ``docs`` (doc_id, text, ...).

    Two documents are linked when the Jaccard similarity of their sets of
    ``size``-word shingles (words between ASCII white space, A-Z lowered) is
    at least ``num`` / ``den``; a text with fewer words is one shingle.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable by
    links, itself included) and class_id (the smallest doc_id with the same
    set).  A null or empty text has no shingles and is linked with nothing.
    Every row is a document of its own: rows that repeat a doc_id have the
    links of their own texts, and each has the smallest doc_id that it reaches,
    by rows without doc_id too; those get the ids of their class and component,
    null where no row of it has one.  An empty table gives an empty result;
    other columns are not read.  Shingles, and texts, are told apart by a
    64-bit hash.
    """
    spark = docs.sparkSession
    like = Similarity(num, den)
    texts = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    read = materialize(texts.mapInArrow(lean(_read_sets(size)), SETS), "sets")
    sets = read.where("kind = 0").select("doc_id", "t", "n", "d1", "d2")
    hot, counts = frequent_cells(read.where("kind = 1").select("doc_id", "data"))
    texts = texts.select("t", "text")

    with_class = sets.where("n > 0")
    heads = materialize(
        with_class.groupBy("n", "d1", "d2").agg(F.min("t").alias("head"), F.min("doc_id").alias("class_id")),
        "classes",
    )
    raw = texts.mapInArrow(lean(_prefixes(size, like, hot, counts)), PREFIXES)
    prefixes = materialize(
        raw.join(heads.select(F.col("head").alias("t")), "t", "left_semi").dropDuplicates(["t"]),
        "prefixes",
    )
    # Each class against the leaders of its smallest hashes: the texts with the
    # fewest rare shingles, which stand in the middle of a group of near copies.
    hashes = (F.octet_length("low") / 8).cast("int")
    low = prefixes.select(
        F.col("t").alias("x"), "ordinary", "low", F.explode(F.sequence(F.lit(1), hashes)).alias("k")
    ).select("x", "ordinary", F.expr("substring(low, 8 * k - 7, 8)").alias("hash"))
    leaders = low.groupBy("hash").agg(F.min(F.struct("ordinary", "x")).alias("first"), F.count("*").alias("n"))
    leaders = materialize(
        leaders.where("n > 1").select("hash", F.col("first.x").alias("y")), "leaders"
    )
    star = low.select("x", "hash").join(leaders, "hash").where("x <> y").select("x", "y").distinct()
    star = materialize(star, "leader-pairs")
    drop_table(leaders)
    star_links = verify_pairs(texts, star, size, like)
    drop_table(star)
    grouped = connected_components(star_links, tag="leader-components")

    members = heads.select(F.col("head").alias("t")).join(
        grouped.withColumnRenamed("node", "t"), "t", "left"
    ).select("t", F.coalesce("component", "t").alias("component"))
    postings = (
        prefixes.join(members, "t")
        .select("t", "n", "l", "cool", "prefix", "component")
        .mapInArrow(lean(_postings(like)), POSTING)
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key")
        .sortWithinPartitions("key")
    )
    # Behind the last match of a pair no more can be shared than is left of
    # either set, and all that is shared before it has been counted.
    most = F.count("*") + F.least(F.min("rest_x"), F.min("rest_y"))
    met = (
        postings.mapInArrow(lean(_meet(like)), MATCHES)
        .groupBy("x", "y")
        .agg(
            F.sum("hits").alias("n"),
            F.max("later").alias("later"),
            F.max("l").alias("l"),
            most.alias("most"),
            F.max("need").alias("need"),
        )
        .where("n + later >= l and most >= need")
        .select("x", "y")
    )
    met = materialize(met, "candidates")
    drop_table(prefixes)
    links = verify_pairs(texts, met, size, like)
    drop_table(met)
    joined = connected_components(links.union(star_links), tag="components")
    drop_table(links)
    drop_table(star_links)
    drop_table(grouped)
    # component and smallest id of each set, then of each component
    nodes = materialize(
        heads.join(joined.withColumnRenamed("node", "head"), "head", "left").select(
            "n", "d1", "d2", "class_id", F.coalesce("component", "head").alias("component")
        ),
        "nodes",
    )
    smallest = materialize(
        nodes.groupBy("component").agg(F.min("class_id").alias("component_id")), "smallest"
    )
    named = materialize(nodes.join(smallest, "component").drop("component"), "named")
    for table in (nodes, smallest, heads, joined):
        drop_table(table)
    return sets.join(named, ["n", "d1", "d2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
    )


def op1_adaptive_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"), size=4, num=85, den=100)
