"""Topic to table, one job per log type; the same code in batch and on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seclog import fixed_values as fv
from seclog import schemas
from seclog.functions.text import evaluated_once
from seclog.operators import network, packets, syslog
from seclog.operators.geo import geo_enrich, geo_unknown
from seclog.sinks.writers import batch_writer


def log_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """Raw log lines out of their JSON messages."""
    data = F.from_json(F.col(value).cast("string"), schemas.ddl(fv.LOG_MESSAGE_SCHEMA))
    parsed = messages.select(evaluated_once(data).alias("data"))
    return parsed.select("data.*").where("message IS NOT NULL")


def network_table(messages: DataFrame, topic: str, ranges: DataFrame | None = None) -> DataFrame:
    return network.event_table(
        network.good_rows(network.parse_messages(messages, topic)), topic, ranges
    )


def packet_table(messages: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    return packets.packet_table(packets.parse_packets(log_messages(messages)), ranges)


def login_table(messages: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """All parsed login lines, placed by source address; private addresses have no place."""
    parsed = syslog.parse_auth(log_messages(messages))
    if ranges is None:
        return geo_unknown(parsed, ["src"])
    return geo_enrich(parsed, ranges, {"src": "sshd_src_ip"}, skip_private=True)


def failed_login_table(messages: DataFrame) -> DataFrame:
    return syslog.failed_logins(syslog.parse_auth(log_messages(messages)))


def system_log_table(messages: DataFrame, source: str, boot_time: Column | None = None) -> DataFrame:
    return syslog.parse_system_log(log_messages(messages), source, boot_time=boot_time)


def rejected_messages(messages: DataFrame, topic: str) -> DataFrame:
    """Messages of a topic that did not parse, as they came."""
    return network.quarantine(network.parse_messages(messages, topic))


def placing_writer(
    path: str,
    table: Callable[[DataFrame], DataFrame],
    rejects_path: str | None = None,
    rejects: Callable[[DataFrame], DataFrame] | None = None,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that builds the table from a batch of messages and
    appends it; what did not parse goes to a table of its own. Geolocation with a large
    range table needs whole batches, so it runs here on a stream."""
    write = batch_writer(path)
    write_rejects = batch_writer(rejects_path) if rejects_path else None

    def place_and_write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # read from the source once, however often the table looks at it
        try:
            write(table(batch), batch_id)
            if write_rejects:
                write_rejects(rejects(batch), batch_id)
        finally:
            batch.unpersist()

    return place_and_write
