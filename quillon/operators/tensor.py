"""Sparse (coordinate) and dense array operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def symmetric_entries(entries: DataFrame) -> DataFrame:
    """All entries of a matrix of which one triangle is stored."""
    other = entries.where("symmetry = 'symmetric' and i <> j")
    swapped = other.withColumns({"i": F.col("j"), "j": F.col("i")})
    return entries.unionByName(swapped)


def sparse_multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two coordinate matrices (i, j, v): joined on the inner index,
    partial sums before the exchange."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("j2"), F.col("v").alias("w"))
    return (
        a.join(right, F.col("j") == F.col("k"))
        .groupBy("i", F.col("j2").alias("j"))
        .agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    )


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def argmax(df: DataFrame, key: list[str], place: str, value: str) -> DataFrame:
    """The place of the largest value of each key; ties to the smallest place."""
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(place)).alias("p")))
    return df.groupBy(*key).agg(best.alias("m")).select(*key, (-F.col("m.p")).alias("argmax"))
