"""Batch writers, and writers for one micro-batch that may be run again safely."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from seclog import schemas

log = logging.getLogger(__name__)

DAY = ["year", "month", "day"]
ROWS_PER_FILE = 20_000_000


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a folder or file, in any store that Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def append_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                 mode: str = "append", rebalance: bool = True) -> None:
    """Parquet by day where the table has day columns.

    Without ``rebalance`` every task writes a file per day it meets. With it rows are
    brought together by day first, and adaptive execution cuts a big day into several
    files; where that is off, a day would be one task, so the rows stay where they are.
    """
    by = partition_by if partition_by is not None else [c for c in DAY if c in df.columns]
    adaptive = df.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true"
    if by and rebalance and adaptive:
        df = df.hint("rebalance", *by)
    writer = df.write.mode(mode).option("maxRecordsPerFile", ROWS_PER_FILE)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, mode="overwrite")


def write_messages(messages: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON message per line, from column ``value``."""
    messages.select("value").write.mode(mode).text(path)


def send_messages(messages: DataFrame, servers: str, topic: str) -> None:
    """Messages to a Kafka topic; needs the connector on the class path."""
    (
        messages.selectExpr("CAST(value AS string) AS value")
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )


def retrying(action: Callable[[], None], attempts: int = 3, least: float = 4, most: float = 10,
             sleep: Callable[[float], None] = time.sleep) -> None:
    """Run an action that is safe to repeat; waits double between ``least`` and ``most``."""
    for attempt in range(1, attempts + 1):
        try:
            return action()
        except Exception:
            if attempt == attempts:
                raise
            wait = min(max(2.0 ** attempt, least), most)
            log.warning("write failed, attempt %d of %d", attempt, attempts, exc_info=True)
            sleep(wait)


def batch_writer(
    path: str, partition_by: list[str] | None = None, *, drop: list[str] | None = None,
    attempts: int = 3, sleep: Callable[[float], None] = time.sleep,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends to a table.

    Rows land in folders that end in the batch number, and a batch that is run again
    replaces just its own folders. One action per batch: the row count is observed on the
    way to the files.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        frame = batch.drop(*(drop or []))
        by = partition_by if partition_by is not None else [c for c in DAY if c in frame.columns]

        def once() -> None:
            seen = Observation()
            (
                frame.withColumn("batch_id", F.lit(batch_id))
                .observe(seen, F.count(F.lit(1)).alias("rows"))
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .option("maxRecordsPerFile", ROWS_PER_FILE)
                .partitionBy(*by, "batch_id")
                .parquet(path)
            )
            log.info("batch %d: %s rows to %s", batch_id, seen.get.get("rows"), path)

        retrying(once, attempts, sleep=sleep)

    return write


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """A table written by ``batch_writer``."""
    return spark.read.parquet(path).drop("batch_id")


def create_table(spark: SparkSession, name: str, table: str, path: str | None = None,
                 replace: bool = False) -> None:
    """A catalog table of a known type, by day, with its column notes."""
    if replace:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    schema = schemas.table_schema(table)

    def column(field) -> str:
        note = field.metadata.get("comment")
        comment = " COMMENT '{}'".format(note.replace("'", "\\'")) if note else ""
        return f"`{field.name}` {field.dataType.simpleString()}{comment}"

    by_day = [c for c in DAY if c in schema.fieldNames()]
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(column(f) for f in schema)}) USING parquet"
        + (f" PARTITIONED BY ({', '.join(by_day)})" if by_day else "")
        + (f" LOCATION '{path}'" if path else "")
    )


def drop_days_before(spark: SparkSession, name: str, cutoff_day: tuple[int, int, int]) -> int:
    """Drop whole days before the cutoff day of a table by day: no data is read.

    Returns the number of days dropped. Rows without a day and those of the cutoff day are kept; use
    ``retain_since`` and a rewrite to cut inside a day.
    """
    named = [
        [part.split("=")[1] for part in row.partition.split("/")]
        for row in spark.sql(f"SHOW PARTITIONS {name}").collect()  # one row per day
    ]
    days = [tuple(map(int, parts)) for parts in named if all(p.isdigit() for p in parts)]
    old = [day for day in days if day < tuple(cutoff_day)]
    for year, month, day in old:
        spark.sql(f"ALTER TABLE {name} DROP PARTITION (year={year}, month={month}, day={day})")
    return len(old)
