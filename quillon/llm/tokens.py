"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at safe boundaries into units whose encodings don't depend on
each other, so a text of any length is encoded piece by piece.  Each worker
encodes every unit that it has not met yet, in batches balanced by bytes, and
keeps the unit's length; a text's count is the sum over its units.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read_table

#: Unicode white space, as the library's pattern has it.
SPACE = "\t-\r \x85\xa0  -     　"
#: One space and a run without white space, or a run of white space that
#: leaves the next word its space.  Each starts where the library's own
#: pattern starts a match, and ends where one ends.
UNIT = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
BATCH_BYTES = 1 << 18  # text that one call of the library encodes
KEPT_UNITS = 1 << 19  # unit lengths that a worker keeps before it forgets half of them
LONG_UNIT = 64  # longer units are encoded but not kept


def balanced(items: list[str], limit: int) -> Iterator[list[str]]:
    """Cut ``items`` into runs of about ``limit`` bytes, longest first so that
    a run holds texts of like length."""
    items = sorted(items, key=len, reverse=True)
    run, size = [], 0
    for x in items:
        run.append(x)
        size += 4 * len(x)
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def forget_half(known: dict, limit: int) -> None:
    """Of more than ``limit`` entries the later half goes: what is met early is
    what is met often."""
    if len(known) > limit:
        for key in list(islice(reversed(known), len(known) // 2)):
            del known[key]


class UnitLengths:
    """Lengths of the encodings of units and texts, by one tokenizers file."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, int] = {}

    def lengths(self, texts: list[str]) -> list[int]:
        got: dict[str, int] = {}
        for run in balanced(texts, BATCH_BYTES):
            encoded = self.tokenizer.encode_batch_fast(run, add_special_tokens=False)
            got.update(zip(run, map(len, encoded)))
        return [got[x] for x in texts]

    def units(self, text: str) -> list[str]:
        if any(x in text for x in self.special):
            # A special token ends the run of white space before it, so only
            # a space between two letters is a safe place to cut.
            return re.findall(r"(?s).+?(?:(?<=[A-Za-z])(?= [A-Za-z])|\Z)", text)
        return UNIT.findall(text)

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; the units of all of them are encoded together."""
        known = self.known
        forget_half(known, KEPT_UNITS)
        cut = [self.units(t) for t in texts]
        new = list({u for units in cut for u in units if u not in known})
        fresh = dict(zip(new, self.lengths(new)))
        long_ = {u: n for u, n in fresh.items() if len(u) > LONG_UNIT}
        known.update((u, n) for u, n in fresh.items() if len(u) <= LONG_UNIT)
        get = known.__getitem__
        if not long_:
            return [sum(map(get, units)) for units in cut]
        return [sum(known[u] if u in known else long_[u] for u in units) for units in cut]


@lru_cache(maxsize=2)
def unit_lengths(vocabulary: str) -> UnitLengths:
    """One for each worker process: what it has met serves its later tasks too."""
    return UnitLengths(vocabulary)


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = 1024, text_col: str = "text"
) -> DataFrame:
    """Count the tokens of each whole text of ``docs`` (doc_id, text, ...).

    ``vocabulary`` is a path of a byte-level tokenizers file that every
    executor has.  Special strings in a text are handled as the library's
    default; no special tokens are added; nothing is truncated or padded.

    Returns doc_id, n_bytes (UTF-8), n_tokens, over_limit.  A null or empty
    text has 0 bytes and 0 tokens; repeated rows each give a row; an empty
    table gives an empty result; other columns are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = unit_lengths(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n_bytes, n_tokens = [], []
            start = 0
            while start < len(texts):  # bounded in text, not in rows
                end, size = start, 0
                while end < len(texts) and size < 4 * BATCH_BYTES:
                    size += len(texts[end])
                    end += 1
                part = texts[start:end]
                n_bytes += [len(t.encode()) for t in part]
                n_tokens += counter.count(part)
                start = end
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_bytes, pa.int64()),
                    pa.array(n_tokens, pa.int64()),
                    pa.array([n > limit for n in n_tokens], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", text_col).mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(
        read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )
