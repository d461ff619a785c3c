"""Toxicity by non-negative positive-unlabelled learning.

A linear model over word and word-stem features is trained from confirmed
toxic texts and unlabelled texts.  The risk of the negative class is estimated
from the unlabelled texts less the positives' share (the class prior), and is
kept from going below zero, so the model cannot win by calling every
unlabelled text negative.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, lean, materialize, read_table

SPACE_BITS = 20  # feature space before selection
EDGES = ".,;:!?\"'()[]{}*#$%&|<>«»„“”’‘`~=-_/\\"
STEMS = (4, 5, 6)  # lengths of the word beginnings that are features
KEPT_WORDS = 1 << 17  # words whose features a task keeps


def fold_of(id_col: str, folds: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of one word: itself and its beginnings."""
    word = word.strip(EDGES)
    if not word:
        return ()
    mask = (1 << SPACE_BITS) - 1
    found = {zlib.crc32(b"=" + word.encode()) & mask}
    for n in STEMS:
        if len(word) >= n:
            found.add(zlib.crc32(word[:n].encode()) & mask)
    return tuple(found)


def text_features(text: str | None, known: dict[str, tuple[int, ...]]) -> np.ndarray:
    """Distinct features of a text, packed."""
    found: set[int] = set()
    for word in set((text or "").lower().split()):
        own = known.get(word)
        if own is None:
            if len(known) > KEPT_WORDS >> 2:
                known.clear()
            own = known[word] = word_features(word)
        found.update(own)
    return np.fromiter(found, np.int32, len(found))


@dataclass
class ToxicityModel:
    """Selected features with their weights, and the bias."""

    weights: dict[int, float]
    bias: float

    def scores(self, texts: Iterable[str | None], known: dict[str, tuple]) -> list[float]:
        out = []
        weights = self.weights
        for text in texts:
            found: set[int] = set()
            for word in set((text or "").lower().split()):
                own = known.get(word)
                if own is None:
                    own = known[word] = tuple(f for f in word_features(word) if f in weights)
                if own:
                    found.update(own)
            z = self.bias + sum(weights[f] for f in sorted(found))
            out.append(float(1 / (1 + np.exp(-z))))
        return out


def select_features(
    in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int, max_features: int, min_texts: int, min_z: float
) -> np.ndarray:
    """Places of the features that are more frequent among ``n_p`` positives than
    among ``n_u`` unlabelled texts, the strongest first."""
    expected = in_u * (n_p / n_u)
    z = np.where(in_p >= min_texts, (in_p - expected) / np.sqrt(expected + 1), -np.inf)
    kept = np.argsort(-z, kind="stable")[:max_features]
    return kept[z[kept] >= min_z]


def train_nnpu(
    positive: list[str | None],
    unlabelled: list[str | None],
    prior: float,
    max_features: int = 4096,
    min_texts: int = 4,
    min_z: float = 4.0,
    **options,
) -> ToxicityModel:
    """Train on texts; ``prior`` is the share of positives among the unlabelled.

    Features are kept when at least ``min_texts`` positives have them and they
    are ``min_z`` standard deviations more frequent there than in the
    unlabelled texts, at most ``max_features``.  Without positives the model
    scores every text near 0.
    """
    known: dict[str, tuple[int, ...]] = {}
    p_rows = [text_features(t, known) for t in positive]
    u_rows = [text_features(t, known) for t in unlabelled]
    if not p_rows or not u_rows:
        return ToxicityModel({}, -6.0)
    space = 1 << SPACE_BITS
    in_p = np.bincount(np.concatenate(p_rows), minlength=space)
    in_u = np.bincount(np.concatenate(u_rows), minlength=space)
    kept = select_features(in_p, in_u, len(p_rows), len(u_rows), max_features, min_texts, min_z)
    column = np.full(space, -1)
    column[kept] = np.arange(len(kept))
    return fit_weights([column[r] for r in p_rows], [column[r] for r in u_rows], kept, prior, **options)


def fit_weights(
    positive: list[np.ndarray],
    unlabelled: list[np.ndarray],
    kept: np.ndarray,
    prior: float,
    rounds: int = 500,
    rate: float = 0.1,
    decay: float = 1e-4,
) -> ToxicityModel:
    """Weights of the features ``kept`` by the non-negative risk estimator.

    Each text is the places in ``kept`` of its features (-1: not kept).  Weights
    are never negative: a toxic passage counts the same in a long text as in a
    short one."""

    def entries(rows):
        at = np.concatenate(rows).astype(np.int64)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        order = np.lexsort((at, owner))
        at, owner = at[order], owner[order]
        return at[at >= 0], owner[at >= 0]

    x_p, of_p = entries(positive)
    x_u, of_u = entries(unlabelled)
    n, n_p, n_u = len(kept), len(positive), len(unlabelled)
    w, b = np.zeros(n), -1.0
    m1, m2 = np.zeros(n + 1), np.zeros(n + 1)

    def sigma(v):
        return 1 / (1 + np.exp(-np.clip(v, -40, 40)))

    for step in range(1, rounds + 1):
        s_p = sigma(b + np.bincount(of_p, w[x_p], n_p))
        s_u = sigma(b + np.bincount(of_u, w[x_u], n_u))
        # sigmoid loss: a positive costs 1 - s, a negative s
        negative_risk = s_u.mean() - prior * s_p.mean()
        d_p = -prior * s_p * (1 - s_p) / n_p
        d_u = s_u * (1 - s_u) / n_u
        d_minus = -prior * s_p * (1 - s_p) / n_p
        if negative_risk >= 0:
            g_p, g_u = d_p + d_minus, d_u
        else:  # step back from the overfitted negative risk alone
            g_p, g_u = -d_minus, -d_u
        g = np.bincount(x_p, g_p[of_p], n) + np.bincount(x_u, g_u[of_u], n)
        g = np.append(g + decay * w, g_p.sum() + g_u.sum())
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.99 * m2 + 0.01 * g * g
        move = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
        w = np.maximum(w - move[:n], 0.0)
        b -= move[n]
    return ToxicityModel({int(f): float(x) for f, x in zip(kept, w)}, float(b))


def _smallest_hashes(ids: DataFrame, n: int) -> DataFrame:
    """``n`` of the ids (doc_id), those with the smallest hashes.

    Only ids below a bound on the hash are put in order: about twice as many as
    are wanted, whatever the size of the table."""
    order = F.xxhash64(F.col("doc_id").cast("string"))
    share, many = 1.0, ids.count()
    if many > 4 * n:
        share = 2 * n / many
    bound = int(-(1 << 63) + share * ((1 << 64) - 1))
    few = ids.where(order <= F.lit(min(bound, (1 << 63) - 1))).distinct()
    return few.orderBy(order, "doc_id").limit(n)


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    max_positive: int = 3000,
    max_unlabelled: int = 6000,
    folds: int = 4,
    held_fold: int = 2,
    max_features: int = 4096,
    min_texts: int = 4,
    min_z: float = 4.0,
) -> ToxicityModel:
    """Fit on bounded samples of the training folds.

    ``max_positive`` and ``max_unlabelled`` bound the rows that the model is
    fitted on, ``max_features`` its features; both samples are the ids with the
    smallest hashes (fewer where a few ids are most of the rows).  Texts become
    features on the executors; the driver gets counts of features and, for each
    text, which of the features kept it has.  The class prior is the share of
    toxic rows among all training labels.  Labels of the held-out fold are never
    read.
    """
    trained = labels.where(fold_of("doc_id", folds) != held_fold).where("toxic is not null")
    prior = trained.agg(F.avg((F.col("toxic") == 1).cast("double"))).head()[0]
    toxic = _smallest_hashes(trained.where("toxic = 1 and doc_id is not null").select("doc_id"), max_positive)
    other = docs.where(fold_of("doc_id", folds) != held_fold).where("doc_id is not null").select("doc_id")
    other = _smallest_hashes(other, max_unlabelled)
    # at most max_positive + max_unlabelled ids
    picked = toxic.withColumn("kind", F.lit(1)).union(other.withColumn("kind", F.lit(0)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [text_features(t.as_py(), known) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(found, pa.list_(pa.int32()))],
                    names=["doc_id", "kind", "found"],
                )

    sample = materialize(
        docs.select("doc_id", "text")
        .join(F.broadcast(picked.toDF("doc_id", "kind")), "doc_id")
        .select("doc_id", "kind", "text")
        .mapInArrow(lean(features), "doc_id long, kind int, found array<int>")
        .dropDuplicates(["doc_id", "kind"]),
        "toxicity-sample",
    )
    sizes = {r["kind"]: r["count"] for r in sample.groupBy("kind").count().collect()}
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    if not n_p or not n_u:
        drop_table(sample)
        return ToxicityModel({}, -6.0)
    counted = (
        sample.select("kind", F.explode("found").alias("f")).groupBy("f")
        .agg(F.count_if(F.col("kind") == 1).alias("p"), F.count_if(F.col("kind") == 0).alias("u"))
        .where(F.col("p") >= min_texts)
        .orderBy("f")
        .toArrow()  # features of a bounded sample that several positives have
    )
    ids, in_p, in_u = (counted.column(k).to_numpy() for k in range(3))
    place = select_features(in_p, in_u, n_p, n_u, max_features, min_texts, min_z)
    kept = ids[place]
    order = np.argsort(kept)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column(2):
                own = row.values.to_numpy() if row.values is not None else np.zeros(0, np.int32)
                at = np.minimum(np.searchsorted(kept, own, sorter=order), max(len(kept) - 1, 0))
                out.append(np.sort(order[at[kept[order[at]] == own]]) if len(kept) else own[:0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))],
                names=["doc_id", "kind", "found"],
            )

    rows = sample.mapInArrow(lean(chosen), "doc_id long, kind int, found array<int>").orderBy("kind", "doc_id").toArrow()
    drop_table(sample)
    kinds = rows["kind"].to_pylist()
    texts = [x.values.to_numpy() for x in rows["found"]]
    return fit_weights(
        [t for t, k in zip(texts, kinds) if k == 1],
        [t for t, k in zip(texts, kinds) if k == 0],
        kept,
        min(max(prior or 0.0, 1e-3), 0.9),
    )


def score_toxicity(
    docs: DataFrame,
    model: ToxicityModel,
    threshold: float = 0.3,
    folds: int = 4,
    held_fold: int = 2,
    keep: list[str] | None = None,
) -> DataFrame:
    """Score each whole text of ``docs`` (doc_id, text, ...).

    Returns the columns ``keep`` (doc_id alone when None), held_out, score (0
    to 1) and predicted.  A null or empty text has the score of a text without
    features; a null doc_id is in the fold of the empty string; repeated rows
    each give a row; an empty table gives an empty result; other columns are
    not read.  A kept column with the name of a result column gives way to it.
    """
    made = ["held_out", "score", "predicted"]
    keep = [c for c in (keep or ["doc_id"]) if c not in made]

    # one struct carries what is kept, whatever its columns are called; the text
    # travels once
    carried = keep if "text" in keep else [*keep, "text"]
    fields = docs.select(F.struct(*keep).alias("row")).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                columns = part.column(0).flatten()
                if len(known) > KEPT_WORDS:
                    known.clear()
                scores = model.scores((t.as_py() for t in columns[carried.index("text")]), known)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.StructArray.from_arrays(columns[: len(keep)], names=keep),
                        part.column(1),
                        pa.array(scores, pa.float64()),
                        pa.array([int(s >= threshold) for s in scores], pa.int32()),
                    ],
                    names=["row", *made],
                )

    read = docs.select(
        F.struct(*carried).alias("row"), (fold_of("doc_id", folds) == held_fold).alias("held_out")
    )
    scored = read.mapInArrow(
        lean(score), fields.add("held_out", "boolean").add("score", "double").add("predicted", "integer")
    )
    return scored.select("row.*", *made)


def op3_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model)
