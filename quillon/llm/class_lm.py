"""Brown class-based n-gram scoring.

Exchange clustering assigns the most frequent words to classes: each word in
turn moves to the class that raises the class-bigram likelihood most.  Every
other word then takes the class that its frequent neighbours make likeliest,
and once more the class that all its neighbours do, by their classes.
A text's probability is the product of class transitions and of word
emissions within the class, both smoothed; an unseen word is one event whose
share is estimated from the words seen once.

The texts are read twice.  The second reading turns them into chunks of local
word numbers and one row for each distinct word of a chunk; these rows are
exchanged by word to gather counts and classes, then by chunk, where every
pair of neighbouring training words counts for the class transitions, and all
this twice, with the frequent neighbours and with the classes of all.  The
chunks are kept as class numbers until these are summed, so no task ever needs
the whole vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, lean, materialize, read_table, release_memory, small_batches
from .neardup import Shingler

FREQUENT = 1600  # words that the exchange moves; more of them lowered no held-out perplexity
CLASSES = 64
CHUNK_TOKENS = 2_000_000
END = b" "  # never a word
END_HASH = -1
PULL = 200.0  # weight of the class frequencies in the smoothed transitions


def is_held_out(id_col: str = "doc_id") -> Column:
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 10 == 0


def _signed(h: np.ndarray) -> np.ndarray:
    """Word hashes as signed numbers, none of them that of the end."""
    h = h.view(np.int64)
    return np.where(h == END_HASH, 1, h)


def word_hash(word: bytes) -> int:
    if word == END:
        return END_HASH
    [h] = Shingler(1).word_hashes(pa.array([word], pa.binary()))
    return int(_signed(h)[0])


class Chunk:
    """Texts as local word numbers; END is number 0."""

    def __init__(self):
        self.doc_ids: list[int | None] = []
        self.held: list[bool] = []
        self.texts: list[np.ndarray] = []
        self.tokens = 0

    def add(self, doc_id, held: bool, words: np.ndarray) -> None:
        """A text by the hashes of its words."""
        self.doc_ids.append(doc_id)
        self.held.append(held)
        self.texts.append(words)
        self.tokens += len(words) + 1

    def full(self) -> bool:
        return self.tokens >= CHUNK_TOKENS

    def number(self) -> None:
        """Give each distinct word its number, once all texts are there."""
        self.lengths = np.array([len(t) + 1 for t in self.texts], np.int64)
        words, at = np.unique(_signed(np.concatenate(self.texts)), return_inverse=True)
        self.words = np.r_[END_HASH, words]
        self.ids = np.zeros(self.tokens, np.uint32)
        inside = np.ones(self.tokens, bool)
        inside[np.cumsum(self.lengths) - 1] = False
        self.ids[inside] = at + 1
        self.texts = []

    def hashes(self) -> np.ndarray:
        return self.words

    def train_ids(self) -> np.ndarray:
        return self.ids[np.repeat(~np.array(self.held, bool), self.lengths)]

    def pack(self) -> tuple[bytes, int]:
        lengths = self.lengths
        known = np.array([d is not None for d in self.doc_ids], np.int64)
        names = np.array([d or 0 for d in self.doc_ids], np.int64)
        held = np.array(self.held, np.int64)
        head = np.stack([names, known, held, lengths], axis=1)
        raw = (
            np.array([len(lengths)], np.int64).tobytes()
            + head.tobytes()
            + self.ids.tobytes()
        )
        return pa.compress(raw, codec="zstd", asbytes=True), len(raw)

    @staticmethod
    def unpack(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc_id, known, held, length) of each text, and all word numbers."""
        raw = pa.decompress(data, size, codec="zstd", asbytes=True)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        head = np.frombuffer(raw, np.int64, 4 * n, 8).reshape(n, 4)
        return head, np.frombuffer(raw, np.uint32, offset=8 + 32 * n)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    chunk, hasher = Chunk(), Shingler(1)
    for batch in batches:
        names, held = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for name, out, words in zip(names, held, hasher.word_hashes(batch.column(2))):
            chunk.add(name, out, words.copy())
            if chunk.full():
                chunk.number()
                yield chunk
                chunk = Chunk()
                release_memory()
    if chunk.doc_ids:
        chunk.number()
        yield chunk


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in _chunks(batches):
        counts = np.bincount(chunk.train_ids(), minlength=len(chunk.words))
        some = counts > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(chunk.hashes()[some]), pa.array(counts[some].astype(np.int64))],
            names=["h", "n"],
        )


PIECES = "b long, i int, h long, n long, near binary, docs binary, size long"
NEAR = np.dtype([("code", "<u2"), ("n", "<u4")])


def _neighbours(ids: np.ndarray, n: int, k: int, before: np.ndarray, after: np.ndarray) -> pa.Array:
    """The neighbours of each of ``n`` words: for each place in ``ids`` the code
    (below ``k``, or -1 for none) of the word before, and k more of that after."""
    # the end of a text has no right neighbour of its own
    after = np.where(ids == 0, -1, after)
    sides = [
        np.unique((ids * (2 * k) + shift + side)[side >= 0], return_counts=True)
        for shift, side in ((0, before), (k, after))
    ]
    keys, sums = (np.concatenate(x) for x in zip(*sides))
    order = np.argsort(keys, kind="stable")
    keys, sums = keys[order], sums[order]
    entries = np.zeros(len(keys), NEAR)
    entries["code"], entries["n"] = keys % (2 * k), sums
    edges = np.searchsorted(keys, np.arange(n + 1) * (2 * k)) * NEAR.itemsize
    return pa.Array.from_buffers(
        pa.binary(),
        n,
        [None, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(entries.tobytes())],
    )


def _pieces(frequent: np.ndarray):
    """Rows of a chunk: one for each distinct word, one with the texts.

    ``near`` lists a word's frequent neighbours in training texts: code is the
    neighbour's place in ``frequent``, plus its length for right neighbours.
    """
    order = np.argsort(frequent)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), len(frequent)
        for seq, chunk in enumerate(_chunks(batches)):
            b = part << 24 | seq
            h = chunk.hashes()
            at = np.minimum(np.searchsorted(frequent, h, sorter=order), k - 1)
            place = np.where(frequent[order[at]] == h, order[at], -1)
            ids = chunk.train_ids().astype(np.int64)
            n = len(h)
            counts = np.bincount(ids, minlength=n)
            near = place[ids]
            before = np.r_[place[0], near[:-1]] if len(ids) else near
            after = np.r_[near[1:], -1] if len(ids) else near
            near_bytes = _neighbours(ids, n, k, before, after)
            del near, before, after, ids
            none = pa.nulls(n, pa.binary())
            for first in range(0, n, 50_000):
                last = min(n, first + 50_000)
                m = last - first
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(m, b), pa.int64()),
                        pa.array(np.arange(first, last), pa.int32()),
                        pa.array(h[first:last]),
                        pa.array(counts[first:last].astype(np.int64)),
                        near_bytes.slice(first, m),
                        none.slice(first, m),
                        pa.nulls(m, pa.int64()),
                    ],
                    names=["b", "i", "h", "n", "near", "docs", "size"],
                )
            data, size = chunk.pack()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b], pa.int64()),
                    pa.array([-1], pa.int32()),
                    pa.nulls(1, pa.int64()),
                    pa.nulls(1, pa.int64()),
                    pa.nulls(1, pa.binary()),
                    pa.array([data], pa.binary()),
                    pa.array([size], pa.int64()),
                ],
                names=["b", "i", "h", "n", "near", "docs", "size"],
            )

    return pieces


def exchange_clusters(
    bigrams: np.ndarray, counts: np.ndarray, n_classes: int, rounds: int = 8
) -> np.ndarray:
    """Class of each word; word 0 (the end) has the class ``n_classes`` alone.

    ``bigrams[u, v]`` counts u before v.  Words start dealt out by frequency;
    in each round every word moves to the class with the best class-bigram
    likelihood, until no word moves."""
    k = len(counts)
    c = n_classes + 1
    by_count = np.argsort(-counts, kind="stable")
    of = np.zeros(k, int)
    of[by_count] = np.arange(k) % n_classes
    of[0] = n_classes
    member = np.eye(c)[of]
    table = member.T @ bigrams @ member

    def f(x):
        return x * np.log(np.maximum(x, 1e-12))

    for _ in range(rounds):
        moved = 0
        for w in by_count:
            if w == 0:
                continue
            old = of[w]
            self_ = bigrams[w, w]
            member[w, old] = 0
            right = bigrams[w] @ member  # class counts after w, without w itself
            left = bigrams[:, w] @ member
            table[old] -= right
            table[:, old] -= left
            table[old, old] -= self_
            # joining class x changes row x, column x and their sums
            rows, columns = table.sum(axis=1), table.sum(axis=0)
            gain = (f(table + right) - f(table)).sum(axis=1) + (
                f(table + left[:, None]) - f(table)
            ).sum(axis=0)
            d = np.diag(table)
            gain += f(d + right + left + self_) - f(d + right) - f(d + left) + f(d)
            # rows and columns of other classes change by w's neighbours too,
            # by the same amount whichever class w joins, but for x itself
            gain -= f(rows + right.sum() + left + self_) - f(rows + left)
            gain -= f(columns + left.sum() + right + self_) - f(columns + right)
            new = int(np.argmax(gain[:n_classes]))
            of[w] = new
            member[w, new] = 1
            table[new] += right
            table[:, new] += left
            table[new, new] += self_
            moved += new != old
        if not moved:
            break
    return of


def _log_transitions(table: np.ndarray, share: np.ndarray, pull: float) -> np.ndarray:
    """Smoothed log of P(class | class before): counts pulled to the class shares."""
    return np.log((table + pull * share) / (table.sum(axis=1, keepdims=True) + pull))


ANSWERS = "b long, i int, h long, n long, class int, x int, y int"


def _classify(frequent: np.ndarray, of: np.ndarray, weight: np.ndarray, prior: np.ndarray):
    """Rows sorted by word to answers for their chunks, and class statistics.

    ``weight`` has a row for each code of a neighbour; frequent words keep ``of``.

    Statistics rows have b = -1: (x, -1) is the tokens, (x, -2) the words and
    (x, -3) the words seen once of a class."""
    place = {int(h): p for p, h in enumerate(frequent)}
    c = len(prior)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((3, c), np.int64)

        def answer(b, i, h, n, near):
            nonlocal totals
            edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            word = np.cumsum(np.r_[True, h[1:] != h[:-1]]) - 1
            words = len(edge)
            sizes = np.fromiter(map(len, near), np.int64, len(near)) // NEAR.itemsize
            flat = np.frombuffer(b"".join(near), NEAR)
            owner = np.repeat(word, sizes)
            score = np.zeros((words, c))
            for first in range(0, len(flat), 1 << 16):
                part = slice(first, first + (1 << 16))
                own = owner[part]
                cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                gains = weight[flat["code"][part]] * flat["n"][part][:, None]
                score[own[cuts]] += np.add.reduceat(gains, cuts, axis=0)
            # the end class is for the end alone
            best = np.argmax((score + prior)[:, : c - 1], axis=1)
            fixed = np.array([place.get(int(x), -1) for x in h[edge]])
            best = np.where(fixed >= 0, of[fixed], best)
            total = np.add.reduceat(n, edge)
            seen = total > 0
            totals += np.stack(
                [
                    np.bincount(best[m], w, c).astype(np.int64)
                    for m, w in (
                        (seen, total[seen]),
                        (seen, None),
                        (total == 1, None),
                    )
                ]
            )
            rows = len(b)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(b),
                    pa.array(i, pa.int32()),
                    pa.array(h),
                    pa.array(total[word]),
                    pa.array(best[word], pa.int32()),
                    pa.nulls(rows, pa.int32()),
                    pa.nulls(rows, pa.int32()),
                ],
                names=["b", "i", "h", "n", "class", "x", "y"],
            )

        held: list[pa.RecordBatch] = []

        def columns(batches_):
            t = pa.Table.from_batches(batches_)
            return (
                *(t.column(x).to_numpy() for x in ("b", "i", "h", "n")),
                t.column("near").to_pylist(),
            )

        for batch in batches:
            # the last word may go on in the next batch
            h = batch.column(2).to_numpy()
            cut = int(np.searchsorted(h, h[-1])) if len(h) else 0
            if held and len(h) and held[-1].column(2)[-1].as_py() != h[0]:
                yield answer(*columns(held))
                held = []
            if cut:
                yield answer(*columns([*held, batch.slice(0, cut)]))
                held = []
            if len(h):
                held.append(batch.slice(cut))
        if held:
            yield answer(*columns(held))
        x = np.tile(np.arange(c), 3)
        y = np.repeat([-1, -2, -3], c)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(x), -1), pa.int64()),
                pa.nulls(len(x), pa.int32()),
                pa.nulls(len(x), pa.int64()),
                pa.array(totals.reshape(-1)),
                pa.nulls(len(x), pa.int32()),
                pa.array(x, pa.int32()),
                pa.array(y, pa.int32()),
            ],
            names=["b", "i", "h", "n", "class", "x", "y"],
        )

    return classify


CLASS_PIECES = "b long, i int, h long, n long, near binary, pairs array<long>"


def _class_pieces(c: int):
    """Rows of a chunk as those of ``_pieces``, where every neighbour is coded by
    its class, and one row with the pairs of classes of its training texts."""

    def pieces(answered: pa.Table, chunk: pa.Table) -> pa.Table:
        head, ids = Chunk.unpack(chunk["docs"][0].as_py(), chunk["size"][0].as_py())
        i, n = answered["i"].to_numpy(), len(answered)
        class_of, h = np.zeros(n, np.int64), np.zeros(n, np.int64)
        class_of[i], h[i] = answered["class"].to_numpy(), answered["h"].to_numpy()
        ids = ids[np.repeat(head[:, 2] == 0, head[:, 3])].astype(np.int64)
        classes = class_of[ids]
        before = np.r_[c - 1, classes[:-1]] if len(ids) else classes
        after = np.r_[classes[1:], -1] if len(ids) else classes
        pairs = np.bincount(before * c + classes, minlength=c * c)
        near = _neighbours(ids, n, c, before, after)
        lists = pa.list_(pa.int64())
        rows = pa.table(
            [
                pa.array(np.full(n + 1, chunk["b"][0].as_py())),
                pa.array(np.arange(-1, n), pa.int32()),
                pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(h)]),
                pa.array(np.r_[0, np.bincount(ids, minlength=n)]),
                pa.concat_arrays([pa.nulls(1, pa.binary()), near]),
                pa.concat_arrays([pa.array([pairs], lists), pa.nulls(n, lists)]),
            ],
            names=["b", "i", "h", "n", "near", "pairs"],
        )
        del ids, classes, before, after, pairs, near
        release_memory()
        # in small batches, each of which Spark holds outside its heap
        return pa.Table.from_batches(rows.to_batches(max_chunksize=50_000))

    return pieces


def _pair_table(pairs: DataFrame, c: int) -> np.ndarray:
    """The sum of the class pairs of all chunks (array column ``pairs``)."""
    table = np.zeros(c * c)
    pair = pairs.select(F.posexplode("pairs").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
    for r in pair.collect():  # the square of the classes
        table[r["at"]] = r["n"]
    return table.reshape(c, c)


CODED = (
    "doc_id array<long>, held_out array<boolean>, n_tokens array<long>, n_known array<long>,"
    " base array<double>, words array<double>, classes binary, size long, pairs array<long>"
)


def _code(c: int, n_all: int, n_words: int):
    """A chunk's texts as classes, with what its words alone add to each score.

    ``pairs`` counts each class (row) before each class over all neighbouring
    training tokens, the end before a text's first word included."""
    kind = np.min_scalar_type(c)

    def code(answered: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
        out = []
        for docs, size in zip(chunk["docs"], chunk["size"]):
            head, ids = Chunk.unpack(docs, int(size))
            n_of = np.zeros(len(answered), np.int64)
            n_of[answered["i"]] = answered["n"]
            class_of = np.zeros(len(answered), np.int64)
            class_of[answered["i"]] = answered["class"]
            n = n_of[ids]
            known = n > 0
            classes = np.where(known, class_of[ids], c)  # c: unseen
            lengths = head[:, 3]
            starts = np.cumsum(lengths) - lengths
            train = np.repeat(head[:, 2] == 0, lengths)
            before = np.r_[c - 1, classes[:-1]]  # the end's class
            pairs = np.bincount(before[train] * c + classes[train], minlength=c * c)
            base = np.log10((n + 0.1) / (n_all + 0.1 * n_words))
            raw = classes.astype(kind).tobytes()
            out.append(
                (
                    [int(i) if there else None for i, there in head[:, :2]],
                    head[:, 2] > 0,
                    lengths,
                    np.add.reduceat(known.astype(np.int64), starts),
                    np.add.reduceat(base, starts),
                    np.add.reduceat(np.log10(np.maximum(n, 1)), starts),
                    pa.compress(raw, codec="zstd", asbytes=True),
                    len(raw),
                    pairs,
                )
            )
        release_memory()
        return pd.DataFrame(out, columns=[x.split()[0] for x in CODED.split(", ")])

    return code


RESULT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long,"
    " base_score double, score double"
)


def score_texts(
    docs: DataFrame, n_frequent: int = FREQUENT, n_classes: int = CLASSES
) -> DataFrame:
    """Score each whole text of ``docs`` (doc_id, text, ...).

    A text's tokens are its words (ASCII white space between, A-Z lowered)
    and one end.  The model learns from texts whose id is not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (the
    smoothed unigram log10 probability) and score (the class model's).  A null
    text is an empty one and has its end alone; a null id is hashed as the
    empty string; repeated rows each count and each give a row; without
    training texts score equals base_score; an empty table gives an empty
    result; other columns are not read.  Words are told apart by a 64-bit hash.
    Tasks hold a range of the vocabulary or some chunks: the number of shuffle
    partitions of the session has to grow with the input.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select("doc_id", is_held_out().alias("held"), "text")
    counts = materialize(
        texts.mapInArrow(lean(_count_words), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")),
        "lm-counts",
    )
    # the frequent words: a fixed number
    top = counts.where(F.col("h") != END_HASH).orderBy(F.desc("n"), "h").limit(n_frequent - 1)
    top = top.collect()
    totals = counts.agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1)).head()
    n_all, n_distinct, n_once = (int(x or 0) for x in totals)
    frequent = np.array([END_HASH] + [r["h"] for r in top], np.int64)
    ends = counts.where(F.col("h") == END_HASH).agg(F.sum("n")).head()[0] or 0
    frequency = np.array([ends] + [r["n"] for r in top], np.int64)
    drop_table(counts)
    pieces = materialize(texts.mapInArrow(lean(_pieces(frequent)), PIECES), "lm-pieces", "zstd")
    words = pieces.where("h is not null").select("b", "i", "h", "n", "near")

    place = {int(h): p for p, h in enumerate(frequent)}

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(frequent), len(frequent)), np.int64)
        for batch in batches:
            for h, near in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                entries = np.frombuffer(near, NEAR)
                entries = entries[entries["code"] < len(frequent)]
                sums[entries["code"], place[h]] += entries["n"]
        x, y = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(sums[x, y])],
            names=["x", "y", "n"],
        )

    found = (
        words.where(F.col("h").isin([int(h) for h in frequent]))
        .select("h", "near")
        .mapInArrow(lean(pairs), "x int, y int, n long")
        .groupBy("x", "y")
        .agg(F.sum("n").alias("n"))
        .toArrow()  # at most the square of the frequent words
    )
    bigrams = np.zeros((len(frequent), len(frequent)))
    bigrams[found["x"].to_numpy(), found["y"].to_numpy()] = found["n"].to_numpy()
    of = exchange_clusters(bigrams, frequency, n_classes)
    member = np.eye(n_classes + 1)[of]
    share = (frequency @ member + 1.0) / (frequency.sum() + n_classes + 1.0)
    log_next = _log_transitions(member.T @ bigrams @ member, share, PULL)
    # a word of class x after class y, and before class z
    weight = np.concatenate([log_next[of], log_next[:, of].T])
    c = n_classes + 1

    def classified(rows: DataFrame, weight: np.ndarray, share: np.ndarray) -> tuple[DataFrame, np.ndarray]:
        """Answers to the rows of all words, and the tokens of each class."""
        made = materialize(
            rows.select("b", "i", "h", "n", "near")
            .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "h")
            .sortWithinPartitions("h")
            .mapInArrow(lean(_classify(frequent, of, weight, np.log(share))), ANSWERS),
            "lm-answers",
            "zstd",
        )
        tokens = np.zeros(c)
        for r in made.where("y = -1").groupBy("x").agg(F.sum("n").alias("n")).collect():
            tokens[r["x"]] = r["n"]
        return made, tokens

    answers, tokens = classified(words, weight, share)
    chunks = materialize(pieces.where("docs is not null").select("b", "docs", "size"), "lm-chunks")
    drop_table(pieces)
    # again, by the classes of all neighbours
    by_class = materialize(
        answers.where("b >= 0")
        .select("b", "i", "h", "class")
        .groupBy("b")
        .cogroup(chunks.groupBy("b"))
        .applyInArrow(_class_pieces(c), CLASS_PIECES),
        "lm-class-pieces",
        "zstd",
    )
    drop_table(answers)
    share = (tokens + 1.0) / (tokens.sum() + c)
    log_next = _log_transitions(_pair_table(by_class.where("i = -1"), c), share, PULL)
    answers, tokens = classified(
        by_class.where("i >= 0"), np.concatenate([log_next, log_next.T]), share
    )
    drop_table(by_class)
    coded = materialize(
        answers.where("b >= 0")
        .select("b", "i", "n", "class")
        .groupBy("b")
        .cogroup(chunks.groupBy("b"))
        .applyInPandas(_code(c, n_all, n_distinct + 1), CODED),
        "lm-coded",
    )
    drop_table(answers)
    table = _pair_table(coded, c)
    unseen = (n_once + 0.1) / (n_all + 0.2)
    shares = (tokens + 1e-9) / (tokens.sum() + 1e-9 * c)
    step = np.concatenate([_log_transitions(table, shares, PULL), np.log(shares)[None]])
    step = (step + np.log1p(-unseen)) / np.log(10)
    # what a token adds besides its own count; an unseen word is one event
    step = np.c_[step - np.log10(np.maximum(tokens, 1)), np.full(c + 1, np.log10(unseen))]
    kind = np.min_scalar_type(c)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, held, lengths, known, base, words_ = (
                    batch.column(x)[row].values for x in range(6)
                )
                data, size = batch.column(6)[row].as_py(), batch.column(7)[row].as_py()
                classes = np.frombuffer(pa.decompress(data, size, codec="zstd", asbytes=True), kind)
                before = np.r_[kind.type(c - 1), classes[:-1]]
                starts = np.cumsum(lengths.to_numpy()) - lengths.to_numpy()
                total = np.add.reduceat(step[before, classes], starts) + words_.to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        held,
                        lengths,
                        known,
                        pa.array(np.full(len(ids), n_all)),
                        base,
                        pa.array(total) if n_all else base,
                    ],
                    names=[x.split()[0] for x in RESULT.split(", ")],
                )

    return coded.drop("pairs").mapInArrow(lean(score), RESULT)


def op2_brown_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"))
