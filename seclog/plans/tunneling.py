"""Which hosts look like they tunnel data through DNS?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from seclog.functions.timing import stamp_now
from seclog.operators import features as f
from seclog.operators.detect import time_range
from seclog.sinks.writers import append_table


def feature_frames(dns: DataFrame, notices: DataFrame, as_of: Column | None = None,
                   interval: str = "15 minutes", time_col: str = "timestamp",
                   ) -> tuple[DataFrame, DataFrame]:
    """Both feature tables; ``as_of`` restricts the input to the interval before it."""
    if as_of is not None:
        dns = f.recent(dns, time_col, as_of, interval)
        notices = f.recent(notices, time_col, as_of, interval)
    return f.dns_features(dns, time_col), f.notice_features(notices, time_col)


def tunneling_scores(dns: DataFrame, notices: DataFrame, as_of: Column | None = None,
                     interval: str = "15 minutes") -> DataFrame:
    """Features, left join and score in one plan. The features of both sides come out of
    their aggregation partitioned by the join keys."""
    return f.score_dns_tunneling(f.join_features(*feature_frames(dns, notices, as_of, interval)))


def store_features(dns: DataFrame, notices: DataFrame, base: str, as_of: Column) -> None:
    dns_rows, notice_rows = feature_frames(dns, notices, as_of)
    append_table(dns_rows, f"{base}/dns_features")
    append_table(notice_rows, f"{base}/notice_features")


def score_stored(dns_features: DataFrame, notice_features: DataFrame, start=None) -> DataFrame:
    """Anomaly rows from stored features, from ``start`` on, stamped with the time of the run."""
    recent = time_range(dns_features, start, time_col="ts_window_start")
    scored = f.score_dns_tunneling(f.join_features(recent, notice_features))
    return stamp_now(scored, "timestamp").select(
        "timestamp", "id_orig_h", "vm_id", "anomaly_type", "score", "details"
    )


def store_baseline(dns_features: DataFrame, base: str, as_of: Column, interval: str = "7 days") -> None:
    baseline = f.query_rate_baseline(dns_features, as_of, interval)
    append_table(baseline.sortWithinPartitions("id_orig_h"), f"{base}/dns_baseline")
