"""Windowed DNS and notice features, baseline and tunnelling score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seclog import fixed_values as fv
from seclog.functions.text import char_entropy, reasons
from seclog.functions.timing import since

WINDOW_SECONDS = 300
KEYS = ["ts_window_start", "id_orig_h", "vm_id"]


def _windowed(df: DataFrame, time_col: str, seconds: int) -> tuple[DataFrame, Column]:
    """The frame with its window in column ``w``, and the start of the window.

    A stream has to group by the window itself to close it. In batch the start alone is
    the key, so rows come out of the aggregation partitioned by what they are joined on.
    """
    framed = df.withColumn("w", F.window(time_col, f"{seconds} seconds"))
    if df.isStreaming:
        return framed, F.col("w.start")
    return framed.withColumn("w", F.col("w.start")), F.col("w")


def dns_features(dns: DataFrame, time_col: str = "timestamp", seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Rate, variety, mean length and mean entropy of names asked for, per window and host.

    Equal names are first counted per window and host. That spreads a busy host over all
    tasks by name, makes the distinct count exact with a plain count, and computes the
    entropy once per name instead of once per row. Runs on a watermarked stream as well.
    """
    windowed, start = _windowed(dns, time_col, seconds)
    host = F.col("id_orig_h").cast("string").alias("id_orig_h")
    per_name = windowed.groupBy("w", host, "vm_id", "query").agg(F.count(F.lit(1)).alias("n"))
    n, name = F.col("n"), F.col("query")
    named = F.sum(F.when(name.isNotNull(), n))
    return (
        per_name.groupBy("w", "id_orig_h", "vm_id")
        .agg(
            (F.sum(n) / F.lit(float(seconds))).alias("query_rate"),
            F.count(name).alias("unique_queries"),
            (F.sum(n * F.length(name)) / named).alias("avg_query_len"),
            (F.sum(n * char_entropy(name)) / F.sum(n)).alias("query_name_entropy"),
        )
        .select(
            start.alias("ts_window_start"), "id_orig_h", "vm_id", "query_rate",
            "unique_queries", "avg_query_len", "query_name_entropy",
        )
    )


def notice_features(
    notices: DataFrame, time_col: str = "timestamp", seconds: int = WINDOW_SECONDS,
    note: str = fv.TUNNELING_NOTE,
) -> DataFrame:
    windowed, start = _windowed(notices.where(F.col("note") == note), time_col, seconds)
    host = F.col("id_orig_h").cast("string").alias("id_orig_h")
    return (
        windowed.groupBy("w", host, "vm_id")
        .agg(
            F.count(F.lit(1)).alias("dns_tunneling_notices"),
            F.avg(F.length("msg")).alias("avg_notice_msg_len"),
        )
        .select(
            start.alias("ts_window_start"), "id_orig_h", "vm_id",
            "dns_tunneling_notices", "avg_notice_msg_len",
        )
    )


def recent(df: DataFrame, time_col: str, as_of: Column, interval: str) -> DataFrame:
    """Rows no older than ``interval`` at ``as_of``."""
    return df.where(since(F.col(time_col), as_of, interval))


def query_rate_baseline(features: DataFrame, as_of: Column, interval: str = "7 days") -> DataFrame:
    """Mean and sample standard deviation of the query rate per host."""
    return (
        recent(features, "ts_window_start", as_of, interval)
        .groupBy("id_orig_h")
        .agg(
            F.avg("query_rate").alias("mean"),
            F.stddev_samp("query_rate").alias("std_dev"),
        )
        .select(
            "id_orig_h", F.lit("QUERY_RATE").alias("metric"), "mean", "std_dev",
            as_of.alias("last_updated"),
        )
    )


def join_features(dns: DataFrame, notices: DataFrame) -> DataFrame:
    """Every DNS feature row with the notice features of its window, host and machine."""
    return dns.join(notices, KEYS, "left")


def score_dns_tunneling(features: DataFrame) -> DataFrame:
    """Weighted score of the signals that fired; rows where none fired are left out."""
    signals = {
        "length": F.col("avg_query_len") > fv.SCORE_QUERY_LENGTH,
        "notices": F.col("dns_tunneling_notices") > fv.SCORE_NOTICES,
        "entropy": F.col("query_name_entropy") > fv.SCORE_ENTROPY,
    }
    score = sum(
        (F.when(fired, F.lit(fv.SCORE_WEIGHTS[name])).otherwise(F.lit(0.0))
         for name, fired in signals.items()),
        F.lit(0.0),
    )

    def valued(label: str, column: str) -> Column:
        return F.concat(F.lit(f"{label}="), F.col(column).cast("string"))

    details = reasons(
        (signals["length"], valued("High AVG_QUERY_LEN", "avg_query_len")),
        (signals["notices"], valued("DNS_TUNNELING_NOTICES", "dns_tunneling_notices")),
        (signals["entropy"], valued("QUERY_NAME_ENTROPY", "query_name_entropy")),
    )
    return (
        features.withColumn("score", score)
        .where(F.col("score") > 0)
        .select(
            "ts_window_start", "id_orig_h", "vm_id",
            F.lit("DNS_Tunneling").alias("anomaly_type"), "score", details.alias("details"),
        )
    )
