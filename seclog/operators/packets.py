"""Packet summaries: tab-separated lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seclog import schemas
from seclog.functions.net import traffic_class
from seclog.functions.text import evaluated_once
from seclog.functions.timing import add_time_parts, from_frame_time
from seclog.operators.geo import geo_enrich, geo_unknown

FIELDS = ["frame_time", "ip_src", "ip_dst", "udp_port", "tcp_port", "ip_proto"]
ENDPOINTS = {"src": "ip_src", "dst": "ip_dst"}


def parse_packets(lines: DataFrame, line: str = "message", keep: list[str] | None = None) -> DataFrame:
    """Typed packets with time parts and traffic class; malformed lines are left out."""
    fields = evaluated_once(F.split(line, "\t")).alias("fields")
    split = lines.select(*(keep or []), fields).where(F.size("fields") == len(FIELDS))
    texts = {name: F.col("fields")[i] for i, name in enumerate(FIELDS)}
    moment = evaluated_once(from_frame_time(texts.pop("frame_time"))).alias("frame_time")
    named = split.select(*(keep or []), moment, *[t.alias(n) for n, t in texts.items()])
    return add_time_parts(named, "frame_time").withColumn(
        "traffic_type", traffic_class(F.split("tcp_port", ","), F.split("udp_port", ","))
    )


def packet_table(packets: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    placed = (
        geo_unknown(packets, list(ENDPOINTS)) if ranges is None
        else geo_enrich(packets, ranges, ENDPOINTS)
    )
    return placed.select(*schemas.TABLE_SCHEMAS["tshark"].fieldNames())
