"""Line-first quality cleaning, in DataFrame functions only.

Every line is judged alone (closing punctuation, menus, symbols, shouting,
repetition, boilerplate phrases, repeats of earlier lines); failing lines are
removed; a document that loses too much of its text is rejected.  A text is
one row throughout: nothing is exploded or exchanged, so a hot source or a
large group of copies is no different from other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BREAK, read_table, text_or_empty

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

#: Phrases of notices that are not prose.
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "released under the",
    "this work is licensed",
    "cookie policy",
    "use of cookies",
    "uses cookies",
    "privacy policy",
    "terms of use",
    "terms of service",
    "javascript",
    "lorem ipsum",
    "click here",
    "read more",
    "sign in",
    "log in",
    "subscribe to",
    "skip to content",
    "powered by",
)


def words_of(text: Column) -> Column:
    """Maximal runs without ASCII white space."""
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def symbol_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def _line_words(line: Column) -> Column:
    return F.struct(line.alias("line"), words_of(line).alias("words"))


def _line_fails(line: Column, n: Column, distinct: Column) -> Column:
    """True for a line of ``n`` words that is a menu, notice, noise or not a sentence."""
    marks = F.length(line) - F.length(F.translate(line, SYMBOLS + "{}=~^\\»›•", ""))
    shouts = F.length(line) - F.length(F.translate(line, "!", ""))
    # a line that breaks off after whole sentences is still prose
    unended = ~line.rlike(r"""[.!?…。！？:;"'”’»)\]]([\x20\x09-\x0D]*$|[\x20\x09-\x0D].{20,}$)""")
    menu_or_symbols = marks > 0.3 * n
    capitals = F.regexp_count(line, F.lit(r"\p{Lu}{2}"))
    shouting = (shouts > 0.6 * n + 2) | ((n >= 4) & (capitals > 0.6 * n))
    repeating = (n >= 10) & (distinct < 0.35 * n)
    notice = (n <= 20) & line.rlike("(?i)" + "|".join(BOILERPLATE))
    return unended | menu_or_symbols | shouting | repeating | notice


def line_first_cleaning(
    docs: DataFrame,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    min_kept_percent: int = 50,
    keep: list[str] | None = None,
) -> DataFrame:
    """Judge and clean ``docs`` (doc_id, text, ...).

    Returns the columns ``keep`` (doc_id alone when None), n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_kept_words, kept and clean_text (the lines
    that stay, in order).  A document is kept when it passes the base checks
    and the lines that stay hold at least ``min_kept_percent`` of its words.

    A null or empty text has no words and fails the base checks; a null id is
    kept as it is; repeated rows are judged alike; an empty table gives an
    empty result; other columns of ``docs`` are not read.  Three-word windows
    are compared by 64-bit hash within one text.  Write the result before
    filtering on ``kept``: Spark copies what a verdict is made of into a filter
    that it moves down, and would then compute it many times over.
    """
    # one struct carries what is kept, whatever its columns are called
    base = docs.select(
        F.struct(*(keep or ["doc_id"])).alias("row"), text_or_empty().alias("text")
    )
    lined = base.select(
        "row",
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        symbol_count(F.col("text")).cast("long").alias("n_symbols"),
        F.transform(
            F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            _line_words,
        ).alias("lines"),
    )
    worded = lined.select(
        "row",
        "word_chars",
        "n_symbols",
        F.flatten("lines.words").alias("w"),
        (F.size("lines") - F.size(F.array_distinct("lines.line"))).cast("long").alias(
            "n_dup_lines"
        ),
        # first lines; strings are told apart by hash, so only texts that repeat a
        # line split it again
        F.transform(
            F.when(
                F.size("lines") > F.size(F.array_distinct("lines.line")),
                F.transform(F.array_distinct("lines.line"), _line_words),
            ).otherwise(F.col("lines")),
            lambda x: F.struct(
                x["line"].alias("line"),
                F.size(x["words"]).alias("n"),
                F.size(F.array_distinct(x["words"])).alias("distinct"),
            ),
        ).alias("first_lines"),
    )
    hashed = worded.select(
        "row",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.size("w").cast("long").alias("n_words"),
        F.filter(
            "first_lines", lambda x: ~_line_fails(x["line"], x["n"], x["distinct"])
        ).alias("stay"),
        F.slice(
            F.transform(
                "w",
                lambda x, i: F.xxhash64(x, F.get(F.col("w"), i + 1), F.get(F.col("w"), i + 2)),
            ),
            F.lit(1),
            F.greatest(F.size("w") - 2, F.lit(0)),
        ).alias("h"),
    )
    # most texts repeat no window; only the others are sorted
    windows = F.when(
        F.size(F.array_distinct("h")) < F.size("h"),
        F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("p")))),
    )
    ranked = hashed.select("*", windows.alias("s")).drop("h")
    # a window is repeated when a neighbour in hash order has its hash
    hits = F.filter(
        F.col("s"),
        lambda x, i: F.get(F.col("s"), i - 1)["h"].eqNullSafe(x["h"])
        | F.get(F.col("s"), i + 1)["h"].eqNullSafe(x["h"]),
    )
    placed = ranked.select("*", F.transform(hits, lambda x: x["p"]).alias("at")).drop("s")
    covered = F.size(
        F.array_union(
            F.array_union(F.col("at"), F.transform("at", lambda p: p + 1)),
            F.transform("at", lambda p: p + 2),
        )
    )
    counted = placed.select(
        "*",
        F.when(F.size("at") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.aggregate("stay", F.lit(0).cast("long"), lambda sum_, x: sum_ + x["n"]).alias(
            "n_kept_words"
        ),
        F.array_join("stay.line", "\n").alias("clean_text"),
    )
    judged = counted.withColumn(
        "base_failed",
        (F.col("n_words") < min_words)
        | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")),
    )
    return judged.select(
        "row.*",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "n_kept_words",
        (
            ~F.col("base_failed")
            & (100 * F.col("n_kept_words") >= min_kept_percent * F.col("n_words"))
        ).alias("kept"),
        "clean_text",
    )


def op7_line_first_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_first_cleaning(read_table(spark, sf_dir, "documents")).drop("clean_text")
