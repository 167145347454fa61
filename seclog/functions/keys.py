"""Surrogate keys and skew salts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_text(*parts: Column) -> Column:
    """One text for the parts, told apart by their lengths; NULL is marked and unlike any text."""
    def marked(part: Column) -> Column:
        text = part.cast("string")
        return F.coalesce(F.concat(F.lit("v"), F.length(text).cast("string"), F.lit(":"), text), F.lit("n"))

    return F.concat(*[marked(p) for p in parts])


def surrogate_key(*parts: Column) -> Column:
    """60-bit number from the SHA-256 of the joined parts.

    A pure function of the row, so facts get the same key as the dimension without a join.
    """
    digest = F.sha2(key_text(*parts), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def key_if_all(*parts: Column) -> Column:
    """Surrogate key where every part is known, else NULL (an equi-join finds no partner)."""
    known = parts[0].isNotNull()
    for part in parts[1:]:
        known = known & part.isNotNull()
    return F.when(known, surrogate_key(*parts))


def spread(columns: list[str], buckets: Column) -> Column:
    """Salt in [0, buckets): steady when a task is run again, and different for copies of
    a row that lie in different input partitions."""
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns], F.spark_partition_id()), buckets)
