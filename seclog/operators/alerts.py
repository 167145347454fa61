"""Incidents as stored rows, messages, text blocks and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seclog.functions.text import attack_type_in, evaluated_once

LISTED = 3  # values a roll-up line names unless told otherwise; the rest is shown as "..."


def incident_rows(incidents: DataFrame, swept_until: Column) -> DataFrame:
    """Rows of the incidents table: stamped with the end of the sweep that found them."""
    return incidents.select(
        swept_until.cast("timestamp").alias("timestamp"),
        "attack_type", "description", "src_ip", "dst_ip", "details",
    )


def to_alert_messages(incidents: DataFrame, stamp: Column) -> DataFrame:
    """One JSON message per incident in column ``value``. The details are JSON already and
    become a member as they are."""
    outer = F.to_json(F.struct(
        F.coalesce("attack_type", F.lit("Unknown")).alias("type"),
        "description",
        F.coalesce("src_ip", F.lit("None")).alias("src_ip"),
        F.coalesce("dst_ip", F.lit("None")).alias("dst_ip"),
        stamp.cast("string").alias("timestamp"),
    ))
    inner = F.coalesce("details", F.lit("{}"))
    opened = F.regexp_replace(outer, r"\}$", "")
    return incidents.select(
        F.concat(opened, F.lit(',"details":'), inner, F.lit("}")).alias("value")
    )


def type_free_text(findings: DataFrame, text: str = "description") -> DataFrame:
    """Add ``attack_type`` to findings written as free text. The text is lowered in a
    projection of its own, once, however many words are looked for."""
    return (
        findings.withColumn("__lowered", F.lower(text))
        .withColumn("attack_type", attack_type_in(F.col("__lowered")))
        .drop("__lowered")
    )


def to_summary_message(text: Column, stamp: Column) -> Column:
    return F.to_json(F.struct(
        F.lit("summary").alias("type"), text.alias("summary"),
        stamp.cast("string").alias("timestamp"),
    ))


def incident_text(messages: DataFrame, value: str = "value") -> DataFrame:
    """Messages as text blocks for a reader."""
    def field(name: str, missing: str) -> Column:
        return F.coalesce(F.get_json_object(value, f"$.{name}"), F.lit(missing))

    def block(lines: list[tuple[str, Column]]) -> Column:
        return F.concat_ws("\n", *[F.concat(F.lit(label), text) for label, text in lines])

    summary = block([
        ("Summary Report:\nDescription: ", field("summary", "No summary provided")),
        ("Timestamp: ", field("timestamp", "N/A")),
    ])
    incident = block([
        ("Attack Type: ", field("type", "Unknown")),
        ("Description: ", field("description", "No description provided")),
        ("Source IP: ", field("src_ip", "None")),
        ("Destination IP: ", field("dst_ip", "None")),
        ("Details: ", field("details", "{}")),
        ("Timestamp: ", field("timestamp", "N/A")),
    ])
    is_summary = F.get_json_object(value, "$.type") == "summary"
    return messages.withColumn("text", F.when(is_summary, summary).otherwise(incident))


def incident_values(incidents: DataFrame) -> DataFrame:
    """Every address and port of every attack type, with its number of incidents, their time range
    and largest figures; kind ``all`` stands for all incidents of the type.

    This is the whole list a roll-up line only names the start of: rows, not one long
    array, so an attack type with very many addresses stays spread out.
    """
    port = F.col("__details.dst_port")
    no_number = F.lit(None).cast("int")

    def entry(kind: str, number: Column, value: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), number.alias("number"), value.alias("value")
        )

    entries = F.array(
        entry("source", no_number, F.col("src_ip")),
        entry("destination", no_number, F.col("dst_ip")),
        entry("port", port, port.cast("string")),
        entry("all", no_number, F.lit("")),
    )
    counted = (
        _with_details(incidents).select("attack_type", "event_time", "__details", F.inline(entries))
        .where("value IS NOT NULL")
        .groupBy("attack_type", "kind", "number", "value")
        .agg(
            F.count(F.lit(1)).alias("incidents"),
            F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"),
            F.max("__details.cpu_user").alias("max_cpu"), F.max("__details.mem_percent").alias("max_memory"),
        )
    )
    return counted


def incident_addresses(incidents: DataFrame) -> DataFrame:
    return (
        incident_values(incidents).where(F.col("kind").isin("source", "destination"))
        .select("attack_type", F.col("kind").alias("role"), F.col("value").alias("ip"), "incidents")
    )


def _with_details(incidents: DataFrame) -> DataFrame:
    """The figures in the details, from one parse."""
    figures = F.from_json("details", "cpu_user double, mem_percent double, dst_port int")
    return incidents.select("*", evaluated_once(figures).alias("__details"))


def _listings(values: DataFrame, listed: int) -> DataFrame:
    """Per attack type and kind: the number of values and the first ``listed`` as text.

    The row-number filter keeps that many rows per group and task before the shuffle, so a
    group never meets in one task.
    """
    group = ["attack_type", "kind"]
    order = Window.partitionBy(*group).orderBy("number", "value")
    first = (
        values.withColumn("rn", F.row_number().over(order))
        .where(F.col("rn") <= listed)
        .groupBy(*group)
        .agg(F.array_sort(F.collect_list(F.struct("rn", "value"))).alias("firsts"))
    )
    counts = values.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    named = F.array_join(F.transform("firsts", lambda x: x["value"]), ", ")
    more = F.when(F.col("n") > listed, F.lit(", ...")).otherwise(F.lit(""))
    return counts.join(first, group).select(*group, "n", F.concat(named, more).alias("listed"))


def incident_rollup(incidents: DataFrame, listed: int = LISTED) -> DataFrame:
    """Per attack type: count, time range, the first ``listed`` addresses and the figures worth naming.

    Everything comes out of one aggregation of the incidents, whose exchange is used again.
    """
    values = incident_values(incidents)
    totals = values.where(F.col("kind") == "all").select(
        "attack_type", F.col("incidents").alias("incident_count"), "first_time", "last_time",
        "max_cpu", "max_memory")

    def of(kind: str, column: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(column)))

    lists = _listings(values.where(F.col("kind") != "all"), listed).groupBy("attack_type").agg(
        *[of(kind, column).alias(f"{kind}_{column}")
          for kind in ("source", "destination", "port") for column in ("n", "listed")]
    )
    strain = F.concat(
        F.lit("Max CPU: "), F.format_string("%.2f", "max_cpu"),
        F.lit("%, Max Memory: "), F.format_string("%.2f", "max_memory"), F.lit("%"),
    )
    details = F.when(F.col("max_cpu").isNotNull() & F.col("max_memory").isNotNull(), strain).when(
        F.col("port_listed").isNotNull(), F.concat(F.lit("Ports targeted: "), "port_listed")
    )
    hour = "yyyy-MM-dd HH"
    return totals.join(lists, "attack_type", "left").select(
        "attack_type", "incident_count", "first_time", "last_time",
        F.concat(F.date_format("first_time", hour), F.lit(" to "),
                 F.date_format("last_time", hour)).alias("time_range"),
        F.coalesce("source_n", F.lit(0)).alias("source_ip_count"),
        F.coalesce("source_listed", F.lit("None")).alias("source_ips"),
        F.coalesce("destination_n", F.lit(0)).alias("destination_ip_count"),
        F.coalesce("destination_listed", F.lit("None")).alias("destination_ips"),
        details.alias("details"),
    )


def rollup_lines(rollup: DataFrame) -> DataFrame:
    """Roll-up rows as the lines of a summary: ``attack_type, line_no, line``."""
    fields = [
        ("Incident Count", F.col("incident_count").cast("string")),
        ("Time Range", F.col("time_range")),
        ("Source IPs", F.col("source_ips")),
        ("Destination IPs", F.col("destination_ips")),
        ("Details", F.coalesce("details", F.lit("None"))),
    ]
    lines = F.array(
        F.concat(F.lit("Attack Type: "), "attack_type"),
        *[F.concat(F.lit(f"  - {label}: "), text) for label, text in fields],
    )
    return rollup.select("attack_type", F.posexplode(lines).alias("line_no", "line"))
