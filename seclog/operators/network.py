"""Network-monitor messages: parse, type, project."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seclog import fixed_values as fv
from seclog import schemas
from seclog.functions.net import loss_severity
from seclog.functions.text import evaluated_once
from seclog.functions.timing import add_time_parts, from_epoch
from seclog.operators.geo import geo_enrich, geo_unknown

ENDPOINTS = {"orig": "id_orig_h", "resp": "id_resp_h"}


def parse_messages(messages: DataFrame, topic: str, value: str = "value") -> DataFrame:
    """JSON messages of one topic as typed columns.

    ``_corrupt_record`` holds the text of a message that is no event of the topic: not valid for the
    schema, NULL (shown as the text "null"), empty, an array, or without the time that every
    event has, as a message of another kind is.
    """
    schema = schemas.message_schema(topic).add(schemas.CORRUPT, "string")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": schemas.CORRUPT}
    parsed = F.from_json(F.col(value).cast("string"), schema, options)
    names = {f.name: schemas.plain_name(f.name) for f in schema.fields}
    text = F.coalesce(F.col(value).cast("string"), F.lit("null"))
    data = messages.select(text.alias("text"), evaluated_once(parsed).alias("data"))
    bad = F.col("data").isNull() | F.col(f"data.{schemas.CORRUPT}").isNotNull() | F.col("data.ts").isNull()
    return data.select(
        *[F.col(f"data.`{f.name}`").alias(names[f.name]) for f in schema.fields if f.name != schemas.CORRUPT],
        F.when(bad, F.col("text")).alias(schemas.CORRUPT),
    )


def good_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col(schemas.CORRUPT).isNull()).drop(schemas.CORRUPT)


def quarantine(parsed: DataFrame) -> DataFrame:
    """Messages that did not parse, for a table of their own."""
    return parsed.where(F.col(schemas.CORRUPT).isNotNull()).select(schemas.CORRUPT)


def add_event_time(parsed: DataFrame) -> DataFrame:
    return add_time_parts(parsed.withColumn("timestamp", from_epoch(F.col("ts"))))


def add_loss_severity(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("loss_severity", loss_severity(F.col("percent_lost")))


def event_table(parsed: DataFrame, topic: str, ranges: DataFrame | None = None) -> DataFrame:
    """The stored table of a topic: time parts, geolocation, chosen columns.

    Without ``ranges`` the geo columns are NULL; that form also runs on a stream.
    """
    timed = add_event_time(parsed)
    if topic == "zeek_capture_loss":
        placed = add_loss_severity(timed)
    elif ranges is None:
        placed = geo_unknown(timed, list(ENDPOINTS))
    else:
        placed = geo_enrich(timed, ranges, ENDPOINTS)
    return placed.select(*fv.TIME_PARTS, "timestamp", *fv.TABLE_COLUMNS[topic])


def union_topics(by_topic: dict[str, DataFrame]) -> DataFrame:
    """All topics in one frame, tagged by ``log_type``; columns a topic lacks are NULL."""
    def tagged(topic: str, parsed: DataFrame) -> DataFrame:
        if topic == "zeek_capture_loss":
            parsed = add_loss_severity(parsed)
        return parsed.withColumn("log_type", F.lit(topic))

    frames = [tagged(topic, parsed) for topic, parsed in by_topic.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
