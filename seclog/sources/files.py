"""Files and tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seclog import fixed_values as fv
from seclog.sources.tail import follow_files


def read_table(
    spark: SparkSession, name_or_path: str, columns: list[str] | None = None,
    where: Column | str | None = None,
) -> DataFrame:
    """A stored table, by folder or catalog name; filter and columns reach the scan."""
    is_path = "/" in name_or_path
    df = spark.read.parquet(name_or_path) if is_path else spark.table(name_or_path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def read_json_files(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """JSON lines; the schema is inferred when none is given, folders give columns."""
    reader = spark.read
    return (reader.schema(schema) if schema else reader).json(path)


def rows(spark: SparkSession, values: Iterable, schema: StructType | str) -> DataFrame:
    """A few rows held in memory."""
    return spark.createDataFrame(list(values), schema)


def source_of_file(path: Column) -> Column:
    """Log source by file name, NULL for files that are not collected."""
    name = F.element_at(F.split(path, "/"), -1)
    source = F
    for ending, label in fv.LOG_FILES.items():
        source = source.when(name.endswith(ending), label)
    return source.otherwise(F.lit(None).cast("string"))


def topic_of(host_group: Column, log_source: Column) -> Column:
    """Topic a log source of a host group is sent to."""
    pairs = [F.lit(x) for pair in fv.TOPIC_OF_SOURCE.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.concat_ws(".", host_group, log_source))


def follow_logs(
    spark: SparkSession, path: str, host_group: str, *, stream: bool = True,
    max_files_per_trigger: int | None = None, growing: bool = False,
) -> DataFrame:
    """Lines of log files with their file, log source and topic; line = message.

    A stream picks up each new file once, as is right for rotated files; with ``growing`` it goes on where
    each file has got to.
    """
    if stream and growing:
        lines = follow_files(spark, path).select(F.col("line").alias("message"), "file")
    else:
        reader = spark.readStream if stream else spark.read
        if stream and max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        lines = reader.text(path).select(
            F.col("value").alias("message"), F.col("_metadata.file_path").alias("file")
        )
    source = source_of_file(F.col("file"))
    return lines.withColumn("log_source", source).withColumn(
        "topic", topic_of(F.lit(host_group), F.col("log_source"))
    )


def parse_tailed(lines: DataFrame, line: str = "value") -> DataFrame:
    """``time LEVEL message`` lines; lines of another form are left out."""
    raw = F.col(line)
    return lines.where(raw.rlike(fv.TAILED_LINE)).select(
        F.try_to_timestamp(F.regexp_extract(raw, fv.TAILED_LINE, 1), F.lit(fv.TAILED_TIME))
        .alias("time"),
        F.regexp_extract(raw, fv.TAILED_LINE, 2).alias("level"),
        F.regexp_extract(raw, fv.TAILED_LINE, 3).alias("message"),
    )


def follow_parsed_log(
    spark: SparkSession, path: str, *, stream: bool = True, growing: bool = False,
) -> DataFrame:
    """Parsed lines of log files; a stream with ``growing`` follows files that are appended to."""
    if stream and growing:
        return parse_tailed(follow_files(spark, path), "line")
    return parse_tailed((spark.readStream if stream else spark.read).text(path))
