"""Host metrics: sparse CPU, memory and disk messages to one row per window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seclog import schemas
from seclog.functions.text import evaluated_once
from seclog.functions.timing import add_time_parts

#: measure -> message field
MEASURES = {
    "cpu_user": "user", "cpu_system": "system", "cpu_iowait": "iowait", "cpu_idle": "idle",
    "mem_used": "used", "mem_total": "total",
    "disk_read_kbs": "rkB_s", "disk_write_kbs": "wkB_s",
}
#: field whose presence says what a message is -> its measures
KINDS = {
    "user": ["cpu_user", "cpu_system", "cpu_iowait", "cpu_idle"],
    "total": ["mem_used", "mem_total"],
    "device": ["disk_read_kbs", "disk_write_kbs"],
}


def parse_metrics(messages: DataFrame, value: str = "value", arrival: str = "timestamp") -> DataFrame:
    """One row per metric message; measures of the other kinds are NULL.

    The kinds share no field but the host, so one parse under the joint schema serves
    all three and the source is read once.
    """
    data = F.from_json(F.col(value).cast("string"), schemas.METRICS_MESSAGE)
    typed = [
        F.when(F.col(f"data.{kind}").isNotNull(), F.col(f"data.{MEASURES[m]}").try_cast("double"))
        .alias(m)
        for kind, measures in KINDS.items()
        for m in measures
    ]
    known = F.coalesce(*[F.col(f"data.{kind}") for kind in KINDS]).isNotNull()
    return (
        messages.select(F.col(arrival).alias("timestamp"), evaluated_once(data).alias("data"))
        .where(known)
        .select("timestamp", *typed, "data.hostname", "data.vm_id")
    )


def first_known(measure: str) -> Column:
    """The earliest value that is known; ties go to the smaller value."""
    value = F.col(measure)
    order = F.when(value.isNotNull(), F.struct(F.col("timestamp"), value))
    return F.min_by(value, order).alias(measure)


def metrics_by_window(metrics: DataFrame, window: str = "10 seconds",
                      watermark: str | None = None) -> DataFrame:
    """Sparse rows combined per window and host."""
    if watermark:
        metrics = metrics.withWatermark("timestamp", watermark)
    combined = (
        metrics.groupBy(F.window("timestamp", window).alias("w"), "hostname", "vm_id")
        .agg(*[first_known(m) for m in MEASURES])
        .withColumn("timestamp", F.col("w.start"))
    )
    return add_time_parts(combined).select(*schemas.TABLE_SCHEMAS["system_metrics"].fieldNames())
