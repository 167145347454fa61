"""Sharding by balanced label propagation, with DataFrame functions only.

Documents with equal texts are linked. Links are held as a star: a group and how many of its documents
lie in each shard, so a group of any size is at most one row per shard, and no pair is ever made. Every
round joins these cells with the best shard of their group that has room; the demand between each two
shards is met as far as swaps and room allow, so loads stay within the quotas. Documents without links
fill what is left. At the end documents beyond a shard's quota take the free places: counts are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seclog.llm.common import digest128, whole_row
from seclog.session import materialize

#: Rounds end by themselves once nothing can move; a group that fills k shards takes about k of them.
SHARDS, ROUNDS, LAW = 24, 40, "rows"
FRAME_BYTES = 8
GROUP = ["d1", "d2"]


def slim(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``row, size, text_crc32, d1, d2`` with the input part ``pid`` and a number ``at`` of their own; kept once.

    NULL and empty texts are equal. A row's number is only fixed by keeping it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d1, d2 = digest128(text)
    kept = docs if keep is None else docs.select(*[f"`{c}`" for c in keep])
    return materialize(docs.select(
        whole_row(kept).alias("row"), (F.octet_length(text) + FRAME_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), d1.alias("d1"), d2.alias("d2"),
        F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("at"),
    ))


def start_shard(shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("start"), F.col("at")), F.lit(shards)).cast("int")


def quotas(n: int, shards: int) -> list[int]:
    """Rows of each shard: at most one apart."""
    return [n // shards + (s < n % shards) for s in range(shards)]


def small_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A table of one row per shard (or pair of shards): small by its definition, so it is broadcast."""
    return F.broadcast(spark.createDataFrame(rows, ddl))


def propagate(cells: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """``d1, d2, shard, n`` after up to ``rounds`` rounds of moves towards each group's shards.

    A cell wants to go where most of its group is, among shards with room. Of what goes from a shard to
    another the part that others give back is always let through, and the rest as far as there is room; a
    group that is only partly let through moves that part of its documents.
    """
    spark, shards = cells.sparkSession, len(quota)
    cells = materialize(cells)
    for number in range(rounds):
        load = {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row per shard
        room = [max(0, quota[s] - load.get(s, 0)) for s in range(shards)]
        # of equal shards another one is liked in each round and group, so that wishes meet in both directions
        liking = F.xxhash64(F.lit(number), *GROUP, "shard")
        known = cells.join(small_table(spark, list(enumerate(room)), "shard int, room long"), "shard")
        known = known.withColumn("liking", F.struct("n", liking.alias("by"), "shard", "room"))
        best = known.where("room > 0").groupBy(*GROUP).agg(F.max("liking").alias("best"))
        # out of a full shard also towards fewer of the group, if all of the cell has room there
        gain = (F.col("best") > F.col("liking")) | ((F.col("room") == 0) & (F.col("best.room") >= F.col("n")))
        wishes = known.join(best, GROUP).where((F.col("best.shard") != F.col("shard")) & gain).select(
            *GROUP, F.col("shard").alias("origin"), F.col("best.shard").alias("to"), "n")
        demand = {(r.origin, r.to): r.n for r in
                  wishes.groupBy("origin", "to").agg(F.sum("n").alias("n")).collect()}  # a row per pair of shards
        shares = granted(demand, room)
        if not shares:
            break
        # what a group may move in all empties its smallest cells first; it has a row per shard at most
        of_group, chance = Window.partitionBy(*GROUP), F.pmod(F.xxhash64(F.lit(-number - 1), *GROUP), F.lit(1 << 30))
        moves = wishes.join(small_table(spark, shares, "origin int, to int, share double"), ["origin", "to"])
        moves = moves.withColumn("may", F.floor(
            F.sum(F.col("n") * F.col("share")).over(of_group) + 1e-9 + chance / float(1 << 30) * (1 - 1e-8)))
        earlier = F.coalesce(F.sum("n").over(of_group.orderBy("n", F.xxhash64(*GROUP, "origin")).rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))
        moves = moves.withColumn("n", F.least("n", F.greatest(F.col("may") - earlier, F.lit(0)))).where("n > 0")
        changes = moves.select(*GROUP, F.inline(F.array(
            F.struct(F.col("origin").alias("shard"), (-F.col("n")).alias("n")),
            F.struct(F.col("to").alias("shard"), F.col("n").alias("n")),
        )))
        cells = materialize(
            cells.unionByName(changes).groupBy(*GROUP, "shard").agg(F.sum("n").alias("n")).where("n > 0"))
    return cells


def granted(demand: dict[tuple[int, int], int], room: list[int]) -> list[tuple[int, int, float]]:
    """(origin, to, share let through): swaps in full, the rest in proportion to the room."""
    swaps = {p: min(n, demand.get(p[::-1], 0)) for p, n in demand.items()}
    rest = {p: n - swaps[p] for p, n in demand.items()}
    into: dict[int, int] = {}
    for (_, to), n in rest.items():
        into[to] = into.get(to, 0) + n
    shares = []
    for (origin, to), n in sorted(demand.items()):
        extra = rest[origin, to] * min(1.0, room[to] / into[to]) if into[to] else 0.0
        share = 1.0 if extra == rest[origin, to] else (swaps[origin, to] + extra) / n
        if share > 0:
            shares.append((origin, to, share))
    return shares


def rows_ahead(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, pid, ahead``: rows with these keys in earlier input parts. A key is one row per part here."""
    before = Window.partitionBy(*keys).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    return df.groupBy(*keys, "pid").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, keep: list[str] | None = None,
) -> DataFrame:
    """``row`` (the ``keep`` columns) of every document with ``size, text_crc32, law, shard, slot, grown_shard``.

    The law is ``rows``: shards have counts at most one apart. Documents with equal texts (NULL is like
    empty) come together as far as quotas allow; a group larger than a shard fills whole shards. Repeated
    rows and rows with NULL ids are documents like others. No rows give none. ``slot`` has no gaps and
    starts from 0 in every shard. ``grown_shard`` belongs to another law and is NULL.
    """
    if shards < 1:
        raise ValueError(f"shards: {shards}")
    named = slim(docs, keep)
    quota = quotas(named.count(), shards)

    # groups of two and more: their documents per shard, to begin with by chance
    start = named.groupBy(*GROUP, start_shard(shards).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    whole = start.withColumn("all", F.sum("n").over(Window.partitionBy(*GROUP)))
    cells = propagate(whole.where(F.col("all") > 1).select(*GROUP, "shard", "n"), quota, rounds)

    # the k-th document of a group goes to the cell that holds place k
    upto = F.sum("n").over(Window.partitionBy(*GROUP).orderBy("shard"))
    places = cells.withColumn("upto", upto).groupBy(*GROUP).agg(
        F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("places"))
    parts = materialize(rows_ahead(named, GROUP).join(places, GROUP).select(*GROUP, "pid", "ahead", "places"))
    in_part = F.row_number().over(Window.partitionBy(*GROUP, "pid").orderBy("at")) - 1
    place = F.get(F.filter("places", lambda p: p["upto"] > F.col("ahead") + F.col("k")), F.lit(0))["shard"]
    linked = F.col("places").isNotNull()
    labelled = materialize(named.join(parts, [*GROUP, "pid"], "left").withColumn("k", in_part).select(
        "row", "size", "text_crc32", "pid", "at", linked.alias("linked"),
        F.when(linked, place).otherwise(start_shard(shards)).alias("shard")))

    # rank in the shard, linked documents first; what is beyond the quota takes the free places in order
    loads = {(r.shard, r.linked): r.n for r in labelled.groupBy("shard", "linked").agg(
        F.count(F.lit(1)).alias("n")).collect()}  # two rows per shard
    tied = [loads.get((s, True), 0) for s in range(shards)]
    full = [tied[s] + loads.get((s, False), 0) for s in range(shards)]
    over, free, beyond, place_no = [], [], 0, 0
    for s in range(shards):
        over.append((s, tied[s], quota[s], beyond))
        beyond += max(0, full[s] - quota[s])
        missing = max(0, quota[s] - full[s])
        if missing:
            free.append((place_no + missing, s, full[s] - place_no))
            place_no += missing
    shape = small_table(docs.sparkSession, over, "shard int, tied long, quota long, beyond long")
    ahead = rows_ahead(labelled, ["shard", "linked"]).drop("n")
    in_kind = F.row_number().over(Window.partitionBy("shard", "linked", "pid").orderBy("at")) - 1
    ranked = labelled.join(ahead, ["shard", "linked", "pid"]).withColumn("k", in_kind).join(shape, "shard")
    rank = F.col("ahead") + F.col("k") + F.when(F.col("linked"), 0).otherwise(F.col("tied"))
    spaces = F.array(*[
        F.struct(F.lit(u).cast("long").alias("upto"), F.lit(s).alias("shard"), F.lit(o).cast("long").alias("shift"))
        for u, s, o in free or [(0, 0, 0)]])
    ranked = ranked.withColumn("rank", rank.cast("long")).withColumn(
        "number", F.col("beyond") + F.col("rank") - F.col("quota")).withColumn(
        "space", F.when(F.col("rank") >= F.col("quota"), F.get(F.filter(
            spaces, lambda p: p["upto"] > F.col("number")), F.lit(0))))
    return ranked.select(
        "row", "size", "text_crc32", F.lit(LAW).alias("law"), F.coalesce("space.shard", "shard").alias("shard"),
        F.when(F.col("space").isNull(), F.col("rank")).otherwise(
            F.col("space.shift") + F.col("number")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
