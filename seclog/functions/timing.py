"""Time columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seclog import fixed_values as fv

_PART = {
    "year": F.year, "month": F.month, "day": F.dayofmonth,
    "hour": F.hour, "minute": F.minute, "second": F.second,
}


def add_time_parts(df: DataFrame, time_col: str = "timestamp") -> DataFrame:
    return df.withColumns({part: _PART[part](F.col(time_col)) for part in fv.TIME_PARTS})


def from_epoch(seconds: Column) -> Column:
    """Epoch seconds as a double to an instant; keeps microseconds."""
    return seconds.cast("timestamp")


def from_iso(text: Column) -> Column:
    """ISO-8601 with offset; NULL where the text is not a time."""
    return text.try_cast("timestamp")


def from_frame_time(text: Column) -> Column:
    """Packet capture time such as ``May  1, 2025 10:00:00.123456789 UTC``."""
    single_blanks = F.regexp_replace(text, r"\s+", " ")
    return F.try_to_timestamp(single_blanks, F.lit(fv.FRAME_TIME))


def shown_time(moment: Column) -> Column:
    """Text of a time: microseconds are shown in full, or left out when zero."""
    full = F.date_format(moment, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.replace(full, F.lit(".000000"), F.lit(""))


def since(time_col: Column, as_of: Column, interval: str) -> Column:
    """True for times no older than ``interval`` before ``as_of``."""
    return time_col >= as_of - F.expr(f"INTERVAL {interval}")


def stamp_now(df: DataFrame, name: str = "created_at") -> DataFrame:
    """Add the time of the run."""
    return df.withColumn(name, F.current_timestamp())
