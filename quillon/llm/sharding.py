"""Sharding by histogram sort, in DataFrame operations only.

Every row gets a 128-bit sort key: a hash of the text, then a hash of the
id.  Counting rounds measure the exact bytes below candidate key boundaries
in all partitions; boundaries that straddle a splitter's target are probed
again with 16 more key bits until each splitter is within tolerance.  The
rows are exchanged once, by the finished splitters.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table, text_or_empty

STEP = 16  # key bits that each counting round adds
LEVELS = 128 // STEP
LOW = -(1 << 63)


def _prefix(level: int) -> Column:
    """The 16 key bits of one level, as a number that sorts as the key does."""
    word = F.col("h") if level < 4 else F.col("h2")
    bits = F.shiftrightunsigned(word, 64 - STEP * (level % 4 + 1))
    bits = bits.bitwiseAND(F.lit((1 << STEP) - 1))
    if level % 4 == 0:  # the sign bit: negative keys sort first
        bits = bits.bitwiseXOR(F.lit(1 << (STEP - 1)))
    return bits


def _key(path: list[int]) -> tuple[int, int]:
    """The smallest key (h, h2) whose levels start with ``path``."""
    words = []
    for start in (0, 4):
        part = (path[start : start + 4] + [0] * 4)[:4]
        value = 0
        for piece in part:
            value = value << STEP | piece
        words.append(value + LOW)
    return words[0], words[1]


def _under(path: list[int]) -> Column:
    """Rows whose key starts with ``path``."""
    conditions = [_prefix(level) == piece for level, piece in enumerate(path)]
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def find_splitters(
    keys: DataFrame, n_shards: int, tolerance: float
) -> tuple[list[tuple[int, int]], list[int]]:
    """Keys at which shards 1 .. n_shards-1 begin, and the round count.

    ``keys`` has h, h2 and size.  A round sends the driver at most 65,536
    cells for each open splitter, whatever the number of rows; each cell has
    exact byte sums over all rows.  A splitter is done when the bytes below it
    are within ``tolerance`` of a shard's bytes, or when no key bits are left.
    """
    first = keys.groupBy(_prefix(0).alias("cell")).agg(F.sum("size").alias("bytes")).collect()
    total = sum(r["bytes"] for r in first)
    if not total:
        return [], []
    share = total / n_shards
    histograms = {(): sorted((r["cell"], r["bytes"]) for r in first)}
    rounds = []
    #: each open splitter: number, path of the cell it lies in, bytes below that cell
    open_ = [(k, (), 0) for k in range(1, n_shards)]
    found: dict[int, tuple[int, int]] = {}
    while open_:
        rounds.append(len(open_))
        deeper = []
        for k, path, below in open_:
            target = k * share
            best = None
            inside = None
            run = below
            for cell, size in histograms[path]:
                for edge, at in ((cell, run), (cell + 1, run + size)):
                    if best is None or abs(at - target) < abs(best[1] - target):
                        best = (edge, at)
                if run <= target < run + size:
                    inside = (path + (cell,), run)
                run += size
            done = (
                abs(best[1] - target) <= tolerance * share
                or inside is None
                or len(inside[0]) == LEVELS
            )
            if done:
                edge = list(path) + [best[0]]
                while len(edge) > 1 and edge[-1] >> STEP:  # past the last cell
                    edge = edge[:-2] + [edge[-2] + 1]
                found[k] = (1 << 63, 0) if edge[0] >> STEP else _key(edge)
            else:
                deeper.append((k, *inside))
        open_ = deeper
        histograms = {}
        for path in sorted({p for _, p, _ in open_}):
            histograms[path] = []
        if histograms:
            level = len(next(iter(histograms)))
            parts = [F.when(_under(list(p)), F.lit(i)) for i, p in enumerate(histograms)]
            got = (
                keys.select(F.coalesce(*parts).alias("at"), _prefix(level).alias("cell"), "size")
                .where("at is not null")
                .groupBy("at", "cell")
                .agg(F.sum("size").alias("bytes"))
                .collect()
            )
            paths = list(histograms)
            for r in got:
                histograms[paths[r["at"]]].append((r["cell"], r["bytes"]))
            histograms = {p: sorted(x) for p, x in histograms.items()}
    return [found[k] for k in sorted(found)], rounds


def _size() -> Column:
    return (F.octet_length(text_or_empty()) + 1).cast("long")


def _sort_key() -> tuple[Column, Column]:
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.xxhash64(text_or_empty()).alias("h"), F.xxhash64(own, F.lit("id")).alias("h2")


def _shard_of(splitters: list[tuple[int, int]]) -> Column:
    """How many splitters are at or below a row's key."""
    shard = F.lit(0)
    for h, h2 in splitters:
        if h < 1 << 63:
            past = (F.col("h") > F.lit(h)) | ((F.col("h") == F.lit(h)) & (F.col("h2") >= F.lit(h2)))
            shard = shard + past.cast("int")
    return shard


def histogram_sort_shards(
    docs: DataFrame, n_shards: int = 16, tolerance: float = 0.002, slice_bits: int = 10
) -> DataFrame:
    """Deal ``docs`` (doc_id, text, ...) into shards of near equal bytes.

    A row's size is the UTF-8 bytes of its text plus 1.  Rows are sorted by
    (hash of text, hash of id, id); the shards are key ranges.  Equal texts
    stay in one shard unless their group is so large that keeping it whole
    would break the tolerance (a share of a shard's bytes): such a group is
    split by id.  Rows with the same id and the same text have one key and
    stay together.

    A null text counts as an empty one; a null id hashes like any value; an
    empty table gives an empty result; other columns of ``docs`` are not read.
    Meant for up to some hundreds of shards: a counting round sends the driver
    at most 65,536 cells for each splitter that is still open.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot (the row's
    place in its shard, without gaps from 0) and grown_shard (null: the law is
    not 'key').
    """
    keys = materialize(
        docs.select(
            "doc_id",
            _size().alias("size"),
            F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
            *_sort_key(),
        ),
        "shard-keys",
    )
    splitters, _ = find_splitters(keys, n_shards, tolerance)
    shard = _shard_of(splitters)
    n = keys.count()
    bits = min(16, max(slice_bits, math.ceil(math.log2(max(n, 1) / (1 << 18) + 1e-9))))
    slice_ = F.shiftright("h", 64 - bits)
    # Slices of the key space are even but for large groups of equal texts;
    # those few slices are cut again by the id's hash.
    hot = [
        r["slice"]
        for r in keys.groupBy(slice_.alias("slice"))
        .count()
        .where(F.col("count") > 4 * max(16, n >> bits))
        .collect()
    ]
    sub = F.when(slice_.isin(hot), F.shiftright("h2", 64 - bits)) if hot else F.lit(None)
    placed = keys.withColumns(
        {"shard": shard, "slice": slice_, "sub": F.coalesce(sub, F.lit(LOW)).cast("long")}
    )
    parts = placed.groupBy("shard", "slice", "sub").count()
    before = Window.partitionBy("shard").orderBy("slice", "sub").rowsBetween(
        Window.unboundedPreceding, -1
    )
    parts = parts.select(
        "shard", "slice", "sub", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")
    )
    within = Window.partitionBy("shard", "slice", "sub").orderBy("h", "h2", "doc_id")
    return (
        placed.join(parts, ["shard", "slice", "sub"])
        .withColumn("slot", F.col("start") + F.row_number().over(within) - 1)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            F.col("slot").cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def write_shards(
    docs: DataFrame, path: str, n_shards: int = 16, tolerance: float = 0.002, files: int = 1
) -> str:
    """Write whole rows of ``docs`` (doc_id, text, ...) under ``path``/shard=N.

    The shards are those of ``histogram_sort_shards``.  The rows cross one
    exchange, by shard, and every shard is written as up to ``files`` files,
    each sorted by key; a shard of many bytes needs several.  Each row is
    written once with all its columns, whether its id is null or repeated; an
    empty table writes no rows.  Returns the name of the partition column:
    ``shard``, with underscores behind it where ``docs`` has that name.
    """
    name = "shard"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    splitters, _ = find_splitters(docs.select(_size().alias("size"), *_sort_key()), n_shards, tolerance)
    rows = docs.select(F.struct("*").alias("row"), *_sort_key())
    rows = rows.select("row", "h", "h2", _shard_of(splitters).alias("shard"))
    (
        rows.repartition(n_shards * files, "shard", F.pmod("h2", F.lit(files)))
        .sortWithinPartitions("shard", "h", "h2")
        .select("row.*", F.col("shard").alias(name))
        .write.partitionBy(name)
        .parquet(path)
    )
    return name


def op6_histogram_sort_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_sort_shards(read_table(spark, sf_dir, "documents"))
