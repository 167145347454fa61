"""Which machine of the inventory an incident belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seclog import fixed_values as fv
from seclog.operators.lookup import MAX_BROADCAST_BYTES, left_lookup

_ASSET = ["name", "short_name", "ip_address"]


def default_asset(assets: DataFrame, names: list[str]) -> tuple | None:
    """The first of ``names`` that is in the inventory: one aggregated row."""
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("short_name"))
    best = F.min(F.struct(rank.alias("rank"), *_ASSET)).alias("best")
    row = assets.where(F.col("short_name").isin(names)).agg(best).first()
    return row.best and tuple(row.best[c] for c in _ASSET)


def attribute_asset(
    incidents: DataFrame,
    assets: DataFrame,
    default_names: list[str] | None = None,
    *,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Add the asset with the incident's source address, else its destination address,
    else the default machine. Where machines share an address, the first by name counts."""
    one_per_address = (
        assets.where("ip_address IS NOT NULL")
        .groupBy(F.col("ip_address").alias("__address"))
        .agg(F.min(F.struct(*_ASSET)).alias("__asset"))
    )

    def renamed(end: str) -> DataFrame:
        return one_per_address.select("__address", F.col("__asset").alias(f"__{end}_asset"))

    found = incidents
    for end in ("src", "dst"):
        found = left_lookup(
            found, renamed(end), f"{end}_ip", "__address",
            max_broadcast_bytes=max_broadcast_bytes,
        )
    fallback = default_asset(assets, default_names or fv.DEFAULT_ASSETS)
    chosen = [F.col("__src_asset"), F.col("__dst_asset")]
    if fallback:
        literals = [F.lit(v).cast("string").alias(c) for v, c in zip(fallback, _ASSET)]
        chosen.append(F.struct(*literals))
    matched_by = (
        F.when(F.col("__src_asset").isNotNull(), "source")
        .when(F.col("__dst_asset").isNotNull(), "destination")
        .when(F.lit(bool(fallback)), "default")
    )
    return (
        found.withColumn("__asset", F.coalesce(*chosen))
        .withColumn("matched_by", matched_by)
        .withColumns({
            "asset_name": F.col("__asset.name"),
            "asset_short_name": F.col("__asset.short_name"),
            "asset_ip": F.col("__asset.ip_address"),
        })
        .drop("__src_asset", "__dst_asset", "__asset")
    )
