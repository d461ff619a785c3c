"""Benchmark decontamination by q-gram lemma filtering.

A text holds a benchmark item within k edits only if a stretch of it shares at
least m + 1 - q - k*q of the item's character q-grams (m: the item's length),
and these lie in a band of neighbouring diagonals.  Shared q-grams are counted
in overlapping diagonal bands; bands that meet the bound are verified by a
banded alignment of the whole item.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, read_table

Q = 12  # characters of a q-gram, but for short items
EDIT_SHARE = 0.05  # edits allowed, as a share of an item's length
BLOCK_CHARS = 8_000_000  # benchmark text that is sent to the executors, and searched, at once
TEXT_CHARS = 1 << 20  # text that is searched at once
TABLE_BITS = 22
PAIRS_AT_ONCE = 1 << 20  # shared q-grams that are listed at a time
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    """Lower case, white space runs as one space."""
    return " ".join((text or "").lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each window of q characters."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(q):
        h *= _FACTOR
        h += codes[j : j + n]
    h ^= h >> np.uint64(29)
    return h * _FACTOR


def banded_alignment(
    item: np.ndarray, text: np.ndarray, k: int, low: int, high: int
) -> tuple[int, int, int] | None:
    """Best place of ``item`` within ``text`` at no more than k edits.

    Only the cells on the diagonals ``low`` to ``high`` (text position less
    item position) are computed.  Returns (edits, start, end) in ``text``, the
    leftmost of the best, or None.
    """
    width, size, never = high - low + 1, len(text), len(item) + 2
    steps = np.arange(width)
    # text with room for the diagonals that run out of it on either side
    room = np.full(size + len(item) + 2 * width + abs(low) + abs(high), -1, np.int64)
    shift = max(0, -low) + 1
    room[shift : shift + size] = text
    came = steps + low  # where the alignment of a cell began
    row = np.where((came >= 0) & (came <= size), 0, never)
    for i, code in enumerate(item, 1):
        before = i + low - 1  # the text position that the first diagonal reads
        change = row + (room[shift + before : shift + before + width] != code)
        skip = np.r_[row[1:] + 1, never]
        new = np.minimum(change, skip)
        start = np.where(change <= skip, came, np.r_[came[1:], 0])
        first, last = -i - low, size - i - low  # diagonals within the text
        if first > 0 or last < width - 1:
            new[: max(first, 0)] = never
            new[max(last + 1, 0) :] = never
        # insertions: the best earlier cell plus its distance
        lowest = np.minimum.accumulate(new - steps)
        better = lowest + steps < new
        if better.any():
            source = np.maximum.accumulate(np.where(new - steps == lowest, steps, 0))
            start = np.where(better, start[source], start)
            new = np.minimum(lowest + steps, never)
            if last < width - 1:
                new[max(last + 1, 0) :] = never
        row, came = new, start
        if row.min() > k:
            return None
    best = int(row.argmin())
    return (int(row[best]), int(came[best]), best + low + len(item))


@dataclass
class ItemIndex:
    """The q-grams of a bounded block of benchmark items."""

    ids: list[int]
    texts: list[str]
    q: int = Q
    share: float = EDIT_SHARE
    hashes: np.ndarray = field(init=False)

    def __post_init__(self):
        self.codes = [_codes(t) for t in self.texts]
        q = self.q
        sizes = [len(c) for c in self.codes]
        # at least one shared q-gram must be demanded
        self.edits = np.array([max(0, min(int(m * self.share), (m - q) // q)) for m in sizes])
        self.need = np.array([m + 1 - q - k * q for m, k in zip(sizes, self.edits)])
        grams = [gram_hashes(c, q) for c in self.codes]
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams]) if grams else item
        order = np.argsort(every, kind="stable")
        self.hashes, self.item, self.place = every[order], item[order], place[order]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def search(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each normal text its items: (item number, start, end, edits)."""
        found: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        if not len(self.hashes):
            return found
        gap = "\0" * self.q  # in no normal item, so no q-gram spans two texts
        codes = _codes(gap.join(texts))
        starts = np.cumsum([0] + [len(t) + self.q for t in texts])
        h = gram_hashes(codes, self.q)
        at = np.flatnonzero(self.table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        low = np.searchsorted(self.hashes, h[at], "left")
        n = np.searchsorted(self.hashes, h[at], "right") - low
        keep = n > 0
        at, low, n = at[keep], low[keep], n[keep]
        if not len(at):
            return found
        bands, counts = self._bands(at, low, n, starts, codes.size + 1)
        items, texts_of, bands = self._unpack(bands, codes.size + 1, len(texts))
        enough = np.flatnonzero(counts >= self.need[items])
        seen: set[tuple[int, int, int]] = set()
        for i, t, band in zip(*(x[enough].tolist() for x in (items, texts_of, bands))):
            k, m = int(self.edits[i]), len(self.codes[i])
            left = band * (k + 1) - codes.size - 1  # the band's first diagonal
            origin, length = int(starts[t]), len(texts[t])
            begin = max(origin, left - k)
            end = min(origin + length, left + 2 * (k + 1) + m + k)
            a = texts[t].find(self.texts[i], begin - origin, end - origin)
            if a >= 0:  # without edits: nothing to align
                match = (0, a + origin - begin, a + m + origin - begin)
            else:
                match = banded_alignment(
                    self.codes[i], codes[begin:end], k, left - k - begin, left + 2 * k + 1 + k - begin
                )
            if match:
                edits, a, b = match
                a, b = a + begin - origin, b + begin - origin
                if (t, i, b) not in seen:
                    seen.add((t, i, b))
                    found[t].append((i, a, b, edits))
        for spans in found:
            spans.sort()
        return found

    def _unpack(self, keys: np.ndarray, base: int, n_texts: int):
        """Item, text and band of packed keys."""
        rest, band = np.divmod(keys, 2 * base + 2)
        item, text = np.divmod(rest, n_texts + 1)
        return item, text, band - 1

    def _bands(self, at, low, n, starts, base: int) -> tuple[np.ndarray, np.ndarray]:
        """How many shared q-grams each band of each text and item has.

        Every text position meets ``n`` item positions with its q-gram.  They are
        listed some at a time and counted at once: a text and an item that repeat
        one q-gram over and over take time, not memory."""
        edge = np.cumsum(n)
        cuts = np.unique(np.searchsorted(edge, np.arange(0, edge[-1], PAIRS_AT_ONCE), "left"))
        parts = []
        for first, last in zip(cuts, [*cuts[1:], len(n)]):
            some = n[first:last]
            ends = np.cumsum(some)
            row = np.repeat(low[first:last] - ends + some, some) + np.arange(ends[-1])
            place = np.repeat(at[first:last], some)
            item = self.item[row].astype(np.int64)
            text = np.searchsorted(starts, place, "right") - 1
            # a diagonal is in two bands, each two strides wide
            band = (place - self.place[row] + base) // (self.edits[item] + 1)
            key = (item * len(starts) + text) * (2 * base + 2) + band
            parts.append(np.unique(np.concatenate([key, key + 1]), return_counts=True))
            if len(parts) > 8:
                parts = [_added(parts)]
        return _added(parts)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by key of several such lists."""
    if len(parts) == 1:
        return parts[0]
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([c for _, c in parts]), len(keys))
    return keys, counts.astype(np.int64)


def item_indexes(ids: list[int], texts: list[str]) -> list[ItemIndex]:
    """Indexes of non-empty normal items, one for each length of q-gram.

    Items too short to share a ``Q``-gram after all their edits have the longest
    q-grams that they do share, the whole item if it may have no edits."""
    groups: dict[int, list[int]] = {}
    for n, text in enumerate(texts):
        m = len(text)
        groups.setdefault(min(Q, m // (int(m * EDIT_SHARE) + 1)), []).append(n)
    return [
        ItemIndex([ids[n] for n in own], [texts[n] for n in own], q) for q, own in sorted(groups.items())
    ]


def _benchmark_blocks(benchmark: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    """The benchmark in blocks of bounded size, whatever its length."""
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.sum(F.length("text"))).head()[0] or 0
    blocks = -(-size // BLOCK_CHARS)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1)))
    for b in range(blocks):
        rows = items.where(part == b).orderBy("item_id", "text").collect()  # one bounded block
        rows = [(r["item_id"], normal(r["text"])) for r in rows]
        rows = [(i, t) for i, t in rows if t]
        if rows:
            yield [i for i, _ in rows], [t for _, t in rows]


SPANS = "doc_id long, item_id long, start_char long, end_char long, n_edits int"


def find_benchmark_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Places where whole texts of ``docs`` hold benchmark items.

    An item of any length is found where it occurs with no more edits than
    ``EDIT_SHARE`` of its length (none below 20 characters), after lower-casing and turning
    white space runs into one space.  The documents are read once for every
    ``BLOCK_CHARS`` characters of the benchmark.  Returns doc_id, item_id, start_char and
    end_char (in the normal form of the text) and n_edits; one row a place.

    Null and empty texts or items hold nothing; a text of any length is
    searched whole; repeated rows each give their rows; empty tables give an
    empty result; other columns are not read.
    """
    result = None
    for ids, texts in _benchmark_blocks(benchmark):

        def search(batches, ids=ids, texts=texts):
            indexes = item_indexes(ids, texts)
            for batch in batches:
                rows = []
                names = batch.column(0).to_pylist()
                for d, index, spans in _search_all(indexes, batch.column(1)):
                    rows += [(names[d], index.ids[i], a, b, e) for i, a, b, e in spans]
                columns = list(zip(*rows)) or [[]] * 5
                kinds = [pa.int64()] * 4 + [pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds)],
                    names=["doc_id", "item_id", "start_char", "end_char", "n_edits"],
                )

        found = docs.select("doc_id", "text").mapInArrow(lean(search), SPANS)
        result = found if result is None else result.union(found)
    if result is None:
        result = docs.sparkSession.createDataFrame([], SPANS)
    return result


def _search_all(indexes: list[ItemIndex], texts: pa.Array):
    """(row, index, spans) of the rows of ``texts`` in which an index finds items."""
    part, size, first = [], 0, 0
    for k in range(len(texts)):
        part.append(normal(texts[k].as_py()))
        size += len(part[-1])
        if size >= TEXT_CHARS or k == len(texts) - 1:
            for index in indexes:
                for d, spans in enumerate(index.search(part)):
                    if spans:
                        yield first + d, index, spans
            part, size, first = [], 0, k + 1


def without_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (text, ...) whose text holds no item of ``benchmark``,
    as ``find_benchmark_passages`` finds them.

    Each row is judged by its own text, whatever its id, and kept with all its
    columns; null and empty texts hold nothing; an empty benchmark keeps all
    rows, an empty table gives an empty result."""
    for ids, texts in _benchmark_blocks(benchmark):

        def clean(batches, ids=ids, texts=texts):
            indexes = item_indexes(ids, texts)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for d, _, _ in _search_all(indexes, batch.column(batch.schema.get_field_index("text"))):
                    keep[d] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(lean(clean), docs.schema)
    return docs


def op8_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and item that it holds: the best place."""
    found = find_benchmark_passages(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    )
    return found.groupBy("doc_id", "item_id").agg(
        F.min("n_edits").alias("n_edits"),
        F.count("*").alias("n_places"),
        F.min_by("start_char", F.struct("n_edits", "start_char")).alias("start_char"),
        F.min_by("end_char", F.struct("n_edits", "start_char")).alias("end_char"),
    )
