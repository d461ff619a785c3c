"""Finite integer sets: domains of loops, hulls, sums over domains."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scan_domain(
    params: DataFrame, loops: list[tuple[str, str, str, int]], where: str | None = None
) -> DataFrame:
    """The points of nested loops, for each row of ``params``.

    ``loops``: name, first and last value (SQL over the parameters and the outer
    names) and stride, from the outermost in; ``where`` is a condition on all.  A
    loop whose last value is below the first has no points."""
    for name, first, last, stride in loops:
        points = F.when(
            F.expr(f"({first}) <= ({last})"), F.sequence(F.expr(first), F.expr(last), F.lit(stride).cast("bigint"))
        )
        params = params.withColumn(name, F.explode(points))
    return params.where(where) if where else params


def sum_over_range(n: Column, term) -> Column:
    """The sum of ``term(i)`` for i from 0 to n - 1."""
    each = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1))
    return F.coalesce(F.aggregate(each, F.lit(0).cast("bigint"), lambda sum_, i: sum_ + term(i)), F.lit(0).cast("bigint"))


def affine_hull(points: DataFrame, key: str) -> DataFrame:
    """Dimension of the smallest flat that holds each key's points (x, y): 0, 1 or
    2, by exact second moments."""
    n, x, y = (F.count("*").cast("decimal(38,0)"), *(F.col(c).cast("decimal(18,0)") for c in ("x", "y")))
    moments = points.groupBy(key).agg(
        n.alias("_n"), F.sum(x).alias("_x"), F.sum(y).alias("_y"),
        *(F.sum((a * b).cast("decimal(38,0)")).alias(f"_{name}") for name, a, b in (("xx", x, x), ("yy", y, y), ("xy", x, y))),
    )
    # doubled and centred; whole numbers throughout
    cxx, cyy, cxy = F.expr("_n * _xx - _x * _x"), F.expr("_n * _yy - _y * _y"), F.expr("_n * _xy - _x * _y")
    spread = moments.select(key, cxx.alias("cxx"), cyy.alias("cyy"), cxy.alias("cxy"))
    flat = F.col("cxx").cast("decimal(19,0)") * F.col("cyy").cast("decimal(19,0)") == F.col("cxy").cast(
        "decimal(19,0)"
    ) * F.col("cxy").cast("decimal(19,0)")
    return spread.select(
        key, F.when((F.col("cxx") == 0) & (F.col("cyy") == 0), 0).when(flat, 1).otherwise(2).alias("dimension")
    )


def convex_hull(points: DataFrame, key: str) -> DataFrame:
    """Vertices (key, x, y) of the convex hull of each key's whole points.

    Only the lowest and the highest point of each x can be vertices, so a key is
    aggregated to these before it is held in one task."""
    ends = points.groupBy(key, "x").agg(F.min("y").alias("low"), F.max("y").alias("high"))

    def hull(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("x")
        found = set()
        for column, sign in (("low", 1), ("high", -1)):
            chain: list[tuple[int, int]] = []
            for x, y in zip(rows["x"].tolist(), rows[column].tolist()):
                while len(chain) > 1:
                    (ax, ay), (bx, by) = chain[-2:]
                    if sign * ((bx - ax) * (y - ay) - (by - ay) * (x - ax)) > 0:
                        break
                    chain.pop()
                chain.append((x, y))
            found.update(chain)
        out = pd.DataFrame(sorted(found), columns=["x", "y"])
        out.insert(0, key, rows[key].iloc[0])
        return out

    kind = dict(points.dtypes)[key]
    return ends.groupBy(key).applyInPandas(hull, f"{key} {kind}, x bigint, y bigint")
