"""Left lookup of a table with one row per key, safe against hot keys.

A lookup of at most ``max_broadcast_bytes`` is broadcast, so the facts do not move. Its bytes are those the
caller has measured, or the statistics of its plan: no job runs to find out, and wide rows count as what
they are. A larger one is joined by shuffle; keys holding more than ``rows_per_salt`` fact rows are split over
several salts on both sides. A NULL key is a key like any other for the salting, so rows without a key
spread out too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from seclog.functions.keys import spread
from seclog.session import materialize

MAX_BROADCAST_BYTES = 32 << 20
ROWS_PER_SALT = 5_000_000


def plan_bytes(df: DataFrame) -> int:
    """The size that Spark's statistics give a plan; very large where nothing is known."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def measured(df: DataFrame) -> tuple[DataFrame, int]:
    """A frame kept in the shared folder, and the bytes of its rows, observed on the way there."""
    seen = Observation()
    texts = [f"`{f.name}`" for f in df.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    fixed = 16 + 8 * len(df.columns)
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(fixed)).cast("long")
    kept = materialize(df.observe(seen, F.coalesce(F.sum(size), F.lit(0)).alias("bytes")))
    return kept, int(seen.get["bytes"])


def left_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    fact_key: str,
    lookup_key: str,
    *,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    rows_per_salt: int = ROWS_PER_SALT,
    lookup_bytes: int | None = None,
    keys_from: DataFrame | None = None,
    key_rows: DataFrame | None = None,
) -> DataFrame:
    """All facts, with the columns of the lookup row whose key equals the fact's.

    ``lookup_bytes`` is the size where the caller has measured it. ``keys_from`` has the same keys as the
    facts, as they were before other lookups, so that finding hot keys does not repeat those. ``key_rows`` are
    counts that the caller has already: each ``key`` and at least as many ``rows`` as the facts have of it.
    """
    keyed = lookup.withColumnRenamed(lookup_key, "__lookup_key")
    size = plan_bytes(lookup) if lookup_bytes is None else lookup_bytes
    if size <= max_broadcast_bytes:
        joined = facts.join(
            F.broadcast(keyed), facts[fact_key] == keyed["__lookup_key"], "left"
        )
        return joined.drop("__lookup_key")
    if key_rows is None:
        key_rows = rows_of_keys(facts if keys_from is None else keys_from, fact_key)
    return _salted_left_lookup(facts, keyed, fact_key, rows_per_salt, key_rows)


def rows_of_keys(facts: DataFrame, key: str) -> DataFrame:
    return facts.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("rows"))


def hot_keys(facts: DataFrame, key: str, rows_per_salt: int) -> DataFrame:
    """Every key with more than ``rows_per_salt`` rows, and the salts it needs.

    There are fewer of them than rows / ``rows_per_salt``.
    """
    return _hot(rows_of_keys(facts, key), rows_per_salt)


def _hot(key_rows: DataFrame, rows_per_salt: int) -> DataFrame:
    salts = F.ceil(F.col("rows") / rows_per_salt).cast("int")
    return key_rows.where(F.col("rows") > rows_per_salt).select(
        F.col("key").alias("__hot_key"), salts.alias("__salts"))


def _salted_left_lookup(
    facts: DataFrame, keyed: DataFrame, fact_key: str, rows_per_salt: int, key_rows: DataFrame
) -> DataFrame:
    # Kept once: both sides have to see the same keys and salts.
    hot, size = measured(_hot(key_rows, rows_per_salt))
    if size <= MAX_BROADCAST_BYTES:  # 10^12 facts have 200,000 of them at most
        hot = F.broadcast(hot)
    salts = F.coalesce(F.col("__salts"), F.lit(1))

    salted_facts = (
        facts.join(hot, F.col(fact_key).eqNullSafe(F.col("__hot_key")), "left")
        .withColumn("__salt", spread(facts.columns, salts))
        .drop("__hot_key", "__salts")
    )
    every_salt = F.explode(F.sequence(F.lit(0).cast("bigint"), (salts - 1).cast("bigint")))
    salted_lookup = (
        keyed.join(hot, F.col("__lookup_key") == F.col("__hot_key"), "left")
        .withColumn("__lookup_salt", every_salt)
        .drop("__hot_key", "__salts")
    )
    same = (F.col(fact_key) == F.col("__lookup_key")) & (
        F.col("__salt") == F.col("__lookup_salt")
    )
    return salted_facts.join(salted_lookup, same, "left").drop(
        "__lookup_key", "__salt", "__lookup_salt"
    )
