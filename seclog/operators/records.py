"""Multi-line records: a start line opens a record, ``- key: value`` lines fill it, any
other line adds to its details."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seclog import fixed_values as fv
from seclog.functions.text import capture

#: Lines per block. A file is numbered block by block, so no task holds a whole file.
BLOCK_LINES = 100_000


def number_records(lines: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Add ``record_no``: the line number of the latest start line at or before a line.

    Within a block it is a running maximum. What a block inherits is the running maximum
    over the blocks before it: one row per block and file, 1/block_lines of the data.
    Lines before the first start line get NULL.
    """
    start = F.when(F.col("text").startswith(fv.RECORD_START), F.col("line_no"))
    marked = (
        lines.withColumn("text", F.trim("line"))
        .withColumn("block", F.floor(F.col("line_no") / block_lines))
        .withColumn("start_no", start)
    )
    earlier = (
        Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    inherited = (
        marked.groupBy("file", "block").agg(F.max("start_no").alias("block_start"))
        .select("file", "block", F.max("block_start").over(earlier).alias("inherited"))
    )
    so_far = (
        Window.partitionBy("file", "block").orderBy("line_no")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        marked.withColumn("own", F.max("start_no").over(so_far))
        .join(inherited, ["file", "block"], "left")
        .withColumn("record_no", F.coalesce("own", "inherited"))
        .drop("block", "start_no", "own", "inherited")
    )


def record_fields(lines: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """One row per line of a record: ``file, record_no, line_no, key, value``."""
    text = F.col("text")
    is_start = text.startswith(fv.RECORD_START)
    key, value = capture(text, fv.RECORD_FIELD, 1), F.trim(F.regexp_extract(text, fv.RECORD_FIELD, 2))
    is_field = key.isNotNull()
    loose = F.trim(F.regexp_replace(text, r"^-\s+", ""))
    return (
        number_records(lines, block_lines)
        .where("record_no IS NOT NULL")
        .select(
            "file", "record_no", "line_no",
            F.when(is_start, "attack_type")
            .when(is_field, F.replace(F.lower(key), F.lit(" "), F.lit("_")))
            .otherwise("details").alias("key"),
            F.when(is_start, F.trim(F.substring(text, len(fv.RECORD_START) + 1, 1 << 30)))
            .when(is_field, value)
            .otherwise(F.concat(F.lit("; "), loose)).alias("value"),
            (~is_start & ~is_field).alias("is_loose"),
        )
    )


def assemble_records(lines: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Records as ``file, record_no, fields`` with a map of their keys: one row per record.

    A repeated key keeps its last value; loose lines after that value are appended to it. Set values
    are aggregated without being gathered; only loose lines, which the row itself holds, are.
    """
    by_key = ["file", "record_no", "key"]
    is_set = ~F.col("is_loose")
    per_key = (
        record_fields(lines, block_lines)
        .groupBy(*by_key)
        .agg(
            F.max(F.when(is_set, F.col("line_no"))).alias("last_set"),
            F.max_by("value", F.when(is_set, F.col("line_no"))).alias("set_value"),
            F.array_sort(F.collect_list(F.when(F.col("is_loose"), F.struct("line_no", "value")))).alias("loose"),
        )
    )
    after = F.filter("loose", lambda p: F.col("last_set").isNull() | (p["line_no"] > F.col("last_set")))
    value = F.concat(
        F.when(F.col("last_set").isNull(), F.lit("")).otherwise(F.coalesce("set_value", F.lit(""))),
        F.array_join(F.transform(after, lambda p: p["value"]), ""),
    )
    return per_key.withColumn("value", value).groupBy("file", "record_no").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("fields")
    )
