"""The derived tables as DataFrames, in batch or as a file stream."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, TimestampType

from checks.views import BASES, VIEWS
from seclog import fixed_values as fv
from seclog.operators import packets
from seclog.session import use_utc
from seclog.sources.topics import as_messages


def _text(name: str, table_of) -> str:
    text = VIEWS[name]
    for base in BASES:
        text = re.sub(rf"\bFROM {base}\b", lambda _: f"FROM {table_of(base)}", text)
    return text


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table; its time column is ``timestamp``."""
    use_utc(spark)
    df = spark.sql(_text(name, lambda base: f"parquet.`{sf_dir}/{base}.parquet`"))
    return _timed(df)


def _timed(df: DataFrame) -> DataFrame:
    if "ts" in df.columns:
        df = df.withColumn("timestamp", F.col("ts").cast("timestamp")).drop("ts")
    return df


def view_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same over a file stream of the events table."""
    use_utc(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )
    temp = f"events_{uuid.uuid4().hex}"
    stream.createOrReplaceTempView(temp)
    df = _timed(spark.sql(_text(name, lambda base: temp)))
    spark.catalog.dropTempView(temp)
    return df


VIEW_OF_TOPIC = {
    "zeek_capture_loss": "v_loss", "zeek_conn": "v_conn", "zeek_dns": "v_dns",
    "zeek_http": "v_http", "zeek_notice": "v_notice", "zeek_ssl": "v_ssl",
}
_DOTTED = {f"id_{end}_{kind}": f"id.{end}_{kind}" for end in ("orig", "resp") for kind in "hp"}


def messages(df: DataFrame, topic: str) -> DataFrame:
    """Rows as the JSON messages a sensor sends: epoch seconds and dotted names."""
    epoch = F.unix_micros("timestamp") / F.lit(1_000_000.0)
    raw = df.withColumn("ts", epoch).withColumn("arrival", F.col("timestamp"))
    names = [c for c in raw.columns if c not in ("event_id", "timestamp", "arrival")]
    sent = raw.select(
        "arrival", F.struct(*[F.col(c).alias(_DOTTED.get(c, c)) for c in names]).alias("m")
    )
    return sent.select(
        F.to_json("m").alias("value"), F.lit(topic).alias("topic"), F.lit(0).alias("partition"),
        F.col("arrival").alias("timestamp"),
    )


def topic_messages(spark: SparkSession, sf_dir: str, topic: str, stream: bool = False) -> DataFrame:
    read = view_stream if stream else view
    return messages(read(spark, sf_dir, VIEW_OF_TOPIC[topic]), topic)


def log_messages(df: DataFrame, columns: tuple[str, ...] = ("message", "hostname", "vm_id")) -> DataFrame:
    return as_messages(df.select(*[c for c in columns if c in df.columns]), "logs")


DETECTION_VIEWS = {
    "zeek_notice": "v_notice", "zeek_http": "v_http", "zeek_conn": "v_conn",
    "zeek_capture_loss": "v_loss", "zeek_dns": "v_dns", "tshark": "v_tshark_raw",
    "system_metrics": "v_metrics",
}
RULE_TABLES = ["zeek_notice", "zeek_http", "zeek_conn", "tshark", "system_metrics"]


def detection_tables(spark: SparkSession, sf_dir: str, names=RULE_TABLES) -> dict[str, DataFrame]:
    read = {name: view(spark, sf_dir, DETECTION_VIEWS[name]) for name in names}
    if "tshark" in read:
        # Date parts that are not folders of a stored table would only be computed again
        # to filter on them.
        read["tshark"] = packets.parse_packets(read["tshark"]).drop(*fv.TIME_PARTS)
    return read


def for_check(df: DataFrame, digits: int = 6) -> DataFrame:
    """Times without zone, doubles rounded: sums of doubles depend on their order."""
    def shown(field):
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(field.dataType, (DoubleType, FloatType)):
            column = F.round(column.cast("double"), digits)
        return column.alias(field.name)

    return df.select(*[shown(f) for f in df.schema.fields])
