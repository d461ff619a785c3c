"""The corpus pipeline: documents from raw rows to token ids.

Stages, each on all that its predecessor kept: toxic documents go; lines that
are not prose go, and documents that lose too much with them; one document of
each class of near duplicates stays; documents that hold a benchmark passage
go; the texts that are left are encoded.  The last stage returns the packed
ids, all others the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.bpe import encode_texts
from quillon.llm.common import materialize, read_table, small_batches
from quillon.llm.decontam import without_passages
from quillon.llm.neardup import jaccard_components
from quillon.llm.quality import line_first_cleaning
from quillon.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not predict as toxic.

    A null or empty text is not toxic; each row, also one without id or with a
    repeated one, has the verdict of its own text; an empty table gives an
    empty result."""
    small_batches(spark)
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, keep=COLUMNS).where("predicted = 0").select(COLUMNS)


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that failed.

    Documents whose every line stays keep their text as it is.  A null or empty
    text fails; each row is judged by its own text, whatever its id; an empty
    table gives an empty result."""
    judged = line_first_cleaning(docs, keep=COLUMNS)
    changed = F.col("n_kept_words") < F.col("n_words")
    cleaned = judged.select(
        "kept",
        "doc_id",
        F.when(changed, F.col("clean_text")).otherwise(F.col("text")).alias("text"),
        "lang",
        "source",
        F.when(changed, F.length("clean_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )
    # a row generator: no filter moves below it and computes the verdict again
    row = F.inline(F.array(F.struct("kept", *COLUMNS)))
    return cleaned.select(row).where("kept").select(COLUMNS)


def number_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of each row's own (row), written so that it stays the same."""
    return materialize(docs.withColumn("row", F.monotonically_increasing_id()), "rows")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate class.

    Classes: five-word shingles, Jaccard similarity of 0.8 or more.  Each row
    is a document, also one without id or with a repeated id: one row of a
    class stays, one with an id if there is any.  Texts without words are
    classes of their own; an empty table gives an empty result."""
    small_batches(spark)
    rows = number_rows(docs)
    classes = jaccard_components(rows.select(F.col("row").alias("doc_id"), "text"))
    keep = (
        classes.select(F.col("doc_id").alias("row"), "component_id")
        .join(rows.select("row", "doc_id"), "row")
        .groupBy("component_id")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"))
        .select("first.row")
    )
    return rows.join(keep, "row", "left_semi").select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage.

    Each row is judged by its own text, whether its id is null or repeated;
    null and empty texts stay; an empty benchmark keeps all rows."""
    small_batches(spark)
    return without_passages(docs, read_table(spark, sf_dir, "benchmark")).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the packed ids of every text that is left.

    Every row gives a row; a null or empty text has no ids."""
    small_batches(spark)
    import public_tokenizers

    encoded = encode_texts(
        docs,
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
        decode=False,
    )
    return encoded.selectExpr("doc_id", "cast(octet_length(ids) div 4 as bigint) AS n_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", clean_lines),
    ("n-gram jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level bpe", encode),
]

#: SQL cannot express the trained model, the join's components or the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each stage's rows are written before the next reads them."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{number}")
    return docs
