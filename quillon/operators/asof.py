"""Last write before read: as-of matching with must, may and kill events.

For every sink the sources before it (times are arrays, compared element by
element) on the same key are matched:

* L is the latest time of a must source or kill before the sink;
* may: the must and may sources at or after L (all, when there is no L);
* must: the must source at L, when nothing else stands at or after L;
* must_no_source: sinks with no event before them; may_no_source: sinks with
  no must source or kill before them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def match_last_writes(events: DataFrame) -> DataFrame:
    """``events`` has key, role (sink, must, may or kill), instance and t.

    Returns relation, source, sink (source null in the no_source relations).
    Each key's times are numbered by the must sources and kills up to them, in
    one window; a sink joins the sources of its key and number, which are those
    from L on, so it reads only what may match it.  An instance that is both a
    must source and a kill at one time counts as one."""
    steps = events.groupBy("key", "t").agg(
        F.bool_or(F.col("role").isin("must", "kill")).alias("firm"),
        F.bool_or(F.col("role") != "sink").alias("any"),
    )
    order = Window.partitionBy("key").orderBy("t")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    spans = steps.select(
        "key", "t",
        F.last(F.when(F.col("firm"), F.col("t")), ignorenulls=True).over(before).alias("latest"),
        F.coalesce(F.max("any").over(before), F.lit(False)).alias("has_any"),
        F.coalesce(F.count_if("firm").over(before), F.lit(0)).alias("firm_before"),
        F.count_if("firm").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("firm_until"),
    )
    placed = events.join(spans, ["key", "t"])
    sinks = placed.where("role = 'sink'").select(
        "key", F.col("t").alias("sink_t"), F.col("instance").alias("sink"), "latest", "has_any",
        F.col("firm_before").alias("span"),
    )
    others = placed.where("role <> 'sink'").select(
        "key", "t", "role", "instance", F.col("firm_until").alias("span")
    )
    near = sinks.join(others, ["key", "span"]).where("t < sink_t")
    at_last = F.col("t") == F.col("latest")
    same = Window.partitionBy("key", "sink", "sink_t")
    ranked = near.withColumn("n", F.size(F.collect_set(F.struct("instance", "t")).over(same)))
    must = ranked.where((F.col("role") == "must") & at_last & (F.col("n") == 1))
    may = near.where(F.col("role").isin("must", "may"))
    pairs = must.select(F.lit("must_dependence").alias("relation"), F.col("instance").alias("source"), "sink")
    pairs = pairs.union(
        may.select(F.col("instance").alias("source"), "sink").distinct()
        .select(F.lit("may_dependence"), "source", "sink")
    )
    none = F.lit(None).cast("string")
    return (
        pairs.union(sinks.where(~F.col("has_any")).select(F.lit("must_no_source"), none, "sink"))
        .union(sinks.where("latest is null").select(F.lit("may_no_source"), none, "sink"))
        .distinct()
    )


def asof_join(
    left: DataFrame, right: DataFrame, on: list[str], time: str, suffix: str = "_right"
) -> DataFrame:
    """Each left row with the latest right row strictly before it, or nulls.

    One window over the union; ties on the right are settled by the largest
    row in column order."""
    values = [c for c in right.columns if c not in (*on, time)]
    blank = F.lit(None)
    packed = F.struct(F.col(time).alias("t"), *values)
    r = right.select(*on, F.col(time).alias("_t"), F.lit(0).alias("_side"), packed.alias("_r"))
    l_ = left.select(*on, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
    both = l_.withColumn("_r", blank.cast(r.schema["_r"].dataType)).unionByName(
        r.withColumn("_l", blank.cast(l_.schema["_l"].dataType))
    )
    order = Window.partitionBy(*on).orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    stamped = both.withColumn("_t", F.unix_micros(F.col("_t").cast("timestamp"))
        if dict(left.dtypes)[time].startswith("timestamp")
        else F.col("_t"))
    found = stamped.withColumn("_m", F.max("_r").over(order)).where("_side = 1")
    return found.select("_l.*", F.col("_m.t").alias(time + suffix), *(F.col("_m")[v].alias(v + suffix) for v in values))
