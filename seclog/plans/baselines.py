"""Baselines from states of single days: a run reads one day, seven days are a merge of seven small tables.

A state holds, per host, how many windows had queries, the sum of their counts and the sum of the squares:
whole numbers, so merging is exact in any order and equal to a look at all rows.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seclog.operators.detect import time_range
from seclog.operators.features import WINDOW_SECONDS
from seclog.sinks.writers import DAY

STATE = ["id_orig_h", "n_windows", "queries", "squares"]
WHOLE = "decimal(38,0)"


def host_states(dns: DataFrame, time_col: str = "timestamp", seconds: int = WINDOW_SECONDS) -> DataFrame:
    """``id_orig_h, n_windows, queries, squares`` over the windows of each host and machine."""
    start = F.window(time_col, f"{seconds} seconds").start.alias("start")
    per_window = dns.groupBy(start, F.col("id_orig_h").cast("string").alias("id_orig_h"), "vm_id").agg(
        F.count(F.lit(1)).alias("n"))
    n = F.col("n").cast(WHOLE)
    return per_window.groupBy("id_orig_h").agg(
        F.count(F.lit(1)).alias("n_windows"), F.sum(n).cast(WHOLE).alias("queries"),
        F.sum((n * n).cast(WHOLE)).cast(WHOLE).alias("squares"))


def rows_of_day(table: DataFrame, day: date, time_col: str = "timestamp") -> DataFrame:
    """Rows of a day; of a table by day only that folder is read."""
    begin = datetime.combine(day, datetime.min.time())
    rows = table.where((F.col(time_col) >= F.lit(begin)) & (F.col(time_col) < F.lit(begin + timedelta(days=1))))
    if set(DAY) <= set(table.columns):
        rows = rows.where((F.col("year") == day.year) & (F.col("month") == day.month) & (F.col("day") == day.day))
    return rows


def store_day(table: DataFrame, path: str, day: date, time_col: str = "timestamp") -> None:
    """The states of one day. Run again, as after late rows, it replaces that day and nothing else."""
    states = host_states(rows_of_day(table, day, time_col), time_col)
    states.write.mode("overwrite").parquet(f"{path.rstrip('/')}/state_day={day.isoformat()}")


def merged(states: DataFrame) -> DataFrame:
    """One state per host from states of disjoint times."""
    return states.groupBy("id_orig_h").agg(
        F.sum("n_windows").alias("n_windows"), F.sum("queries").cast(WHOLE).alias("queries"),
        F.sum("squares").cast(WHOLE).alias("squares"))


def baseline_of(states: DataFrame, as_of: Column, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Mean and sample standard deviation of the query rate per host, as ``query_rate_baseline`` gives them."""
    n, total, squares = (F.col(c) for c in STATE[1:])
    spread = (squares * n.cast("decimal(20,0)")).cast(WHOLE) - (total * total).cast(WHOLE)
    pairs = n.cast("double") * (n - 1)
    return merged(states).select(
        "id_orig_h", F.lit("QUERY_RATE").alias("metric"),
        (total.cast("double") / n / seconds).alias("mean"),
        (F.sqrt(F.try_divide(spread.cast("double"), F.nullif(pairs, F.lit(0.0)))) / seconds).alias("std_dev"),
        as_of.alias("last_updated"))


def baseline_from_days(
    states: DataFrame, as_of: datetime, days: int = 7, rows: DataFrame | None = None, time_col: str = "timestamp",
) -> DataFrame:
    """The baseline of the last ``days`` days from the stored states of whole days.

    Where ``as_of`` is within a day, the part of the first day that counts comes from its ``rows``.
    """
    begin = as_of - timedelta(days=days)
    first = begin.date() if begin.time() == datetime.min.time() else begin.date() + timedelta(days=1)
    wanted = states.where(F.col("state_day") >= F.lit(first)).select(*STATE)
    if begin.date() != first:
        if rows is None:
            raise ValueError("the first day counts in part: its rows are needed")
        # a window that began before is left out, so the part starts with the next window
        late = -(-(begin - datetime.min).total_seconds() // WINDOW_SECONDS)
        start = datetime.min + timedelta(seconds=late * WINDOW_SECONDS)
        part = time_range(rows_of_day(rows, begin.date(), time_col), start, time_col=time_col)
        wanted = wanted.unionByName(host_states(part, time_col))
    return baseline_of(wanted, F.lit(as_of).cast("timestamp"))
