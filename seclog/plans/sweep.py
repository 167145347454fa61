"""Incremental sweep: run all rules over the time since the last sweep.

``incremental_sweep`` takes tables as they are. ``sweep_logged`` takes tables with a log of their batches and so knows
which rows are new: a minute that gets rows after it was swept is swept again, and its incidents are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seclog.operators.alerts import incident_rows
from seclog.operators.detect import detect_all, time_range
from seclog.sinks.batchlog import BatchLog
from seclog.sinks.writers import path_exists

LOOK_BACK = timedelta(hours=24)
SETTLE = timedelta(hours=1)
TIME_COLUMN = {"tshark": "frame_time"}
#: One row per finished sweep: its end, its folder, and up to which version of each table's log it saw rows.
STATE = "swept_until timestamp_ntz, sweep string, versions string"


def last_sweep(spark: SparkSession, state: str) -> datetime | None:
    """End of the last sweep that was finished; None before the first. One row per sweep is read."""
    if not path_exists(spark, state):
        return None
    return spark.read.schema(STATE).parquet(state).agg(F.max("swept_until")).first()[0]


def remember(spark: SparkSession, state: str, end: datetime, sweep: str | None = None,
             versions: Mapping[str, int] | None = None) -> None:
    """The new end becomes visible as a whole, as one more file; the latest end counts."""
    row = (end, sweep, json.dumps(versions) if versions is not None else None)
    spark.createDataFrame([row], STATE).coalesce(1).write.mode("append").parquet(state)


def next_range(
    spark: SparkSession, state: str, as_of: datetime, look_back: timedelta = LOOK_BACK
) -> tuple[datetime, datetime]:
    """From the end of the last sweep (a day back at first) to an hour before ``as_of``.

    The end is a whole minute, so no minute is split over two sweeps.
    """
    end = (as_of - SETTLE).replace(second=0, microsecond=0)
    return last_sweep(spark, state) or end - look_back, end


def incremental_sweep(
    spark: SparkSession, tables: Mapping[str, DataFrame], state: str, out: str,
    as_of: datetime, look_back: timedelta = LOOK_BACK,
) -> tuple[datetime, datetime] | None:
    """Write all incidents of [start, end); remember ``end`` once they are written.

    The folder is named by the start, which does not move until the end is remembered: a sweep
    that failed at any point and runs again, however much later, replaces what it had
    written. Returns the range, or None when there is nothing new.
    """
    start, end = next_range(spark, state, as_of, look_back)
    if start >= end:
        return None
    if last_sweep(spark, state) is None:
        remember(spark, state, start)  # else a first sweep run again later would start later
    swept = {
        name: time_range(df, start, end, TIME_COLUMN.get(name, "timestamp"), end_open=True)
        for name, df in tables.items()
    }
    found = incident_rows(detect_all(swept), F.lit(str(end)))
    # The folder itself is replaced, so that a sweep that finds nothing now clears it too.
    found.write.mode("overwrite").parquet(f"{out.rstrip('/')}/sweep={start.strftime('%Y%m%d%H%M%S%f')}")
    remember(spark, state, end)
    return start, end


def seen_versions(spark: SparkSession, state: str) -> dict[str, int]:
    """Versions of the tables' logs at the last finished sweep."""
    if not path_exists(spark, state):
        return {}
    last = spark.read.schema(STATE).parquet(state).where("versions IS NOT NULL").agg(
        F.max_by("versions", "swept_until")).first()[0]
    return json.loads(last) if last else {}


def changed_minutes(new_rows: Mapping[str, DataFrame], before: datetime) -> DataFrame | None:
    """Minutes before a time of which tables have got rows; at most one row per minute."""
    minutes = None
    for name, rows in new_rows.items():
        moment = F.col(TIME_COLUMN.get(name, "timestamp"))
        own = rows.where(moment < F.lit(before).cast("timestamp")).select(
            F.date_trunc("minute", moment).alias("minute")).distinct()
        minutes = own if minutes is None else minutes.unionByName(own)
    return None if minutes is None else minutes.distinct()


def sweep_logged(
    spark: SparkSession, paths: Mapping[str, str], state: str, out: str, as_of: datetime,
    look_back: timedelta = LOOK_BACK,
) -> tuple[datetime, datetime] | None:
    """A sweep of tables with batch logs: [start, end) as ``incremental_sweep``, and again every earlier minute
    that has got rows since the last sweep.

    Written in order: the incidents, the minutes they replace, and last the state, with which both count. A
    sweep that fails and runs again replaces what it had written. Before the first range nothing is swept.
    """
    start, end = next_range(spark, state, as_of, look_back)
    if start >= end:
        return None
    first = last_sweep(spark, state) is None
    if first:
        remember(spark, state, start)
    seen, versions, tables, new_rows = seen_versions(spark, state), {}, {}, {}
    for name, path in paths.items():
        table = BatchLog(spark, path)
        rows, versions[name] = table.rows_since(seen.get(name, -1))
        tables[name] = table.read()
        if rows is not None and not first and name in seen:
            new_rows[name] = rows
    sweep = start.strftime("%Y%m%d%H%M%S%f")
    late = changed_minutes(new_rows, start)
    replaced = f"{state.rstrip('/')}_replaced/sweep={sweep}"
    oldest_late = None
    if late is not None:
        oldest = spark.read.schema(STATE).parquet(state).agg(F.min("swept_until")).first()[0]
        late.where(F.col("minute") >= F.lit(oldest).cast("timestamp")).write.mode("overwrite").parquet(replaced)
        late = spark.read.parquet(replaced).select(F.col("minute").alias("late_minute"))  # a row each
        oldest_late = late.agg(F.min("late_minute").cast("timestamp_ntz")).first()[0]
    swept = {}
    for name, df in tables.items():
        moment = TIME_COLUMN.get(name, "timestamp")
        # One scan for new and late rows; it begins where the oldest late minute does.
        rows = time_range(df, oldest_late or start, end, moment, end_open=True)
        if oldest_late is not None:
            marked = rows.join(F.broadcast(late), F.date_trunc("minute", rows[moment]) == late["late_minute"], "left")
            new = F.col(moment) >= F.lit(str(start)).cast(df.schema[moment].dataType)
            rows = marked.where(new | F.col("late_minute").isNotNull()).drop("late_minute")
        swept[name] = rows
    found = detect_all(swept)
    rows = found.withColumn("minute", F.date_trunc("minute", "event_time"))
    stamped = rows.select(F.lit(str(end)).cast("timestamp").alias("timestamp"), *[
        c for c in rows.columns if c != "event_time"])
    stamped.write.mode("overwrite").parquet(f"{out.rstrip('/')}/sweep={sweep}")
    remember(spark, state, end, sweep, versions)
    return start, end


def read_incidents(spark: SparkSession, state: str, out: str) -> DataFrame:
    """Incidents of the finished sweeps, without those of minutes that a later one has swept again."""
    found = spark.read.option("basePath", out).parquet(out).withColumn("sweep", F.col("sweep").cast("string"))
    finished = spark.read.schema(STATE).parquet(state).where("sweep IS NOT NULL").select("sweep")
    found = found.join(F.broadcast(finished), "sweep", "left_semi")  # a row per sweep
    folder = f"{state.rstrip('/')}_replaced"
    if not path_exists(spark, folder):
        return found
    again = spark.read.parquet(folder).select("minute", F.col("sweep").cast("string").alias("sweep"))
    latest = again.join(F.broadcast(finished), "sweep", "left_semi").groupBy("minute").agg(
        F.max("sweep").alias("last_sweep"))
    return found.join(latest, "minute", "left").where(
        F.col("last_sweep").isNull() | (F.col("sweep") >= F.col("last_sweep"))).drop("last_sweep")
