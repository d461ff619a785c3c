"""Custom keyed state over an event stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "user_id long, n long, total double, largest double"
STATE = "n long, total double, largest double"


def running_totals(events: DataFrame) -> DataFrame:
    """Per user, over all micro-batches so far: events, sum and largest value.

    The state of a user is three numbers, whatever the number of events; a
    row is given for each user that a micro-batch touches."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, largest = state.get if state.exists else (0, 0.0, float("-inf"))
        for part in parts:
            n += len(part)
            total += float(part["value"].sum())
            largest = max(largest, float(part["value"].max()))
        state.update((n, total, largest))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total], "largest": [largest]})

    return (
        events.select("user_id", F.coalesce("value", F.lit(0.0)).alias("value"))
        .groupBy("user_id")
        .applyInPandasWithState(update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)
    )


def deduplicated(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events without repeats of an id within the watermark."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", delay)
        .dropDuplicatesWithinWatermark(["event_id"])
    )
