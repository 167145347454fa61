"""Start streaming queries. Every query has a checkpoint and runs in append mode."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seclog import fixed_values as fv
from seclog.functions.timing import stamp_now
from seclog.operators import metrics as metric_ops
from seclog.operators import star
from seclog.operators.geo import GeoTable
from seclog.operators.network import add_event_time
from seclog.session import disk_state
from seclog.sinks.batchlog import tables_writer
from seclog.sinks.writers import DAY

log = logging.getLogger(__name__)

EVENT_DELAY = "6 hours"
METRIC_DELAY = "10 seconds"
EVERY = "10 seconds"


def _trigger(every: str | None) -> dict:
    """Micro-batches at an interval, or (None) one run over all that is there."""
    return {"processingTime": every} if every else {"availableNow": True}


def start_table(df: DataFrame, path: str, checkpoint: str, *, every: str | None = EVERY,
                partition_by: list[str] | None = None, name: str | None = None) -> StreamingQuery:
    """Append to a Parquet table through the file sink, which commits each batch once."""
    by = partition_by if partition_by is not None else [c for c in DAY if c in df.columns]
    writer = (
        df.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every))
    )
    writer = writer.partitionBy(*by) if by else writer
    return (writer.queryName(name) if name else writer).start()


def start_batches(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, *,
                  every: str | None = EVERY, name: str | None = None) -> StreamingQuery:
    """Hand every micro-batch to ``write``, for work that needs whole batches."""
    writer = (
        df.writeStream.outputMode("append").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(**_trigger(every))
    )
    return (writer.queryName(name) if name else writer).start()


def start_console(df: DataFrame, checkpoint: str, every: str | None = "5 seconds",
                  rows: int = 20) -> StreamingQuery:
    return (
        df.writeStream.format("console").outputMode("append")
        .option("truncate", False).option("numRows", rows)
        .option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start()
    )


def start_archive(messages: DataFrame, path: str, checkpoint: str, *, every: str | None = EVERY,
                  topics: list[str] | None = None) -> StreamingQuery:
    """Messages as text files, by topic and partition."""
    wanted = messages.where(F.col("topic").isin(topics or fv.ARCHIVED_TOPICS))
    return (
        wanted.select("value", "topic", "partition")
        .writeStream.format("text").outputMode("append")
        .partitionBy("topic", "partition")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every)).start()
    )


def metrics_stream(messages: DataFrame, window: str = "10 seconds",
                   delay: str = METRIC_DELAY) -> DataFrame:
    """Metric messages combined per window; a window comes out once, when it is closed."""
    return metric_ops.metrics_by_window(metric_ops.parse_metrics(messages), window, delay)


def once(events: DataFrame, keys: list[str], time_col: str = "timestamp",
         delay: str = EVENT_DELAY) -> DataFrame:
    """Rows whose keys were not seen within the delay."""
    watermarked = events.withWatermark(time_col, delay)
    return watermarked.dropDuplicatesWithinWatermark(keys)


def star_tables(places: GeoTable | None = None) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """How each of the four star tables is made from a batch of events, each of them once; endpoints get ``places``
    if given. Facts go to the writer by day, in files of even size."""
    return {
        "dim_time": star.dim_time, "dim_host": star.dim_host,
        "dim_network_entity": lambda events: star.dim_network_entity(events, places),
        "fact_zeek_events": lambda events: stamp_now(star.facts_of_unique(events)).hint("rebalance", *DAY),
    }


def unique_events(parsed: DataFrame, delay: str = EVENT_DELAY) -> DataFrame:
    """United topics of a stream with their times, every event once within the delay."""
    return star.unique_events(add_event_time(parsed).withWatermark("timestamp", delay))


def start_star(
    parsed: DataFrame, path: str, checkpoint: str, *, places: GeoTable | None = None, delay: str = EVENT_DELAY,
    every: str | None = EVERY, tables: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> StreamingQuery:
    """All four star tables from one read of the topics, by one query.

    Each table has its own log of batches: a failure after two of them repeats the other two. Dimension
    tables are deltas, the keys of each batch; ``merge_star`` gives the dimension itself. Tables are made from
    fact rows, as ``star.unique_events`` gives them. The digests of the delay's events are kept on disk: they are as
    many as the events and would fill the executors' memory. What shuffles, state and kept rows take on disk grows with
    a micro-batch, not with the stream: a run over much that is there should have it in parts, in order of time.
    """
    write = tables_writer(tables or star_tables(places), path)
    with disk_state(parsed.sparkSession, changes=every is not None):
        return start_batches(unique_events(parsed, delay), write, checkpoint, every=every, name="star")


def merge_star(name: str, deltas: DataFrame) -> DataFrame:
    """A dimension from the deltas its stream has written."""
    if name == "dim_network_entity":
        return star.merge_entities(deltas)
    return deltas.distinct()


def wait_for(spark: SparkSession, queries: list[StreamingQuery], all_of_them: bool = False) -> None:
    """Until any query ends (service), or until all have (one run over what is there)."""
    if all_of_them:
        for query in queries:
            query.awaitTermination()
    else:
        spark.streams.awaitAnyTermination()
