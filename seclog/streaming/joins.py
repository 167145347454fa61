"""Joins of two streams with state that is let go.

The star tables need none, as their keys are hashes of a row's own columns. Where the partner is a stream of its
own, both sides are cut into windows of event time and joined within them: once the watermark has passed a window,
its rows leave the state, and left rows without a partner come out with NULLs.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_within_windows(
    left: DataFrame, right: DataFrame, keys: list[str], *, window: str = "1 hour", delay: str = "6 hours",
    time_col: str = "timestamp",
) -> DataFrame:
    """Every left row with each distinct right row that has its keys in its window of event time.

    All right columns but the keys and the time are added, so their names must be new. A NULL key meets nothing.
    Rows later than ``delay`` are dropped on either side of a stream and counted by its progress. In batch the
    result is that of a stream in which nothing is late. A hot key's rows of one window meet in one task; choose
    the window by what that may hold.
    """
    added = [c for c in right.columns if c not in (*keys, time_col)]
    clash = [c for c in added if c in left.columns]
    if clash:
        raise ValueError(f"columns of both sides: {clash}")
    # the window is the one column of event time that goes on; the time itself becomes a plain value
    own = left.withWatermark(time_col, delay).withColumn("__window", F.window(time_col, window)).withColumn(
        time_col, F.timestamp_micros(F.unix_micros(time_col)))
    other = (
        right.withWatermark(time_col, delay)
        .select(F.window(time_col, window).alias("__of_window"), *[F.col(k).alias(f"__of_{k}") for k in keys], *added)
        .dropDuplicates()  # a window is among the columns, so this state is let go with it
    )
    same = [F.col("__window") == F.col("__of_window"), *[F.col(k) == F.col(f"__of_{k}") for k in keys]]
    joined = own.join(other, reduce(and_, same), "leftOuter")
    return joined.drop("__window", "__of_window", *[f"__of_{k}" for k in keys])
