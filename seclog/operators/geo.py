"""Geolocation: addresses against a table of ranges, of both address families.

``ranges`` has ``ip_lo, ip_hi, latitude, longitude, city``; the bounds are IPv4 numbers, or texts of
either family. Ranges may lie in one another or overlap: of those that hold an address the one that
starts last wins, of equal starts the one that ends first, so the narrowest of nested ones.

A range is cut into address prefixes of whole hex digits, as a routing table is: no two prefixes of a range
overlap, and those of a network are one. An address has one prefix of each length, so placing it is an equality
join per length in use, and of at most one hit per length the best one wins. Prefixes of rare lengths are
made longer until few lengths are left. Nothing is sorted by network and no two rows are compared but
for equality, whatever the table's size. A table whose bytes are few is broadcast and rows are placed where they
are; with a large one a batch looks up each distinct address once, and a stream joins by shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seclog.functions.net import address_key, is_private
from seclog.functions.text import bound
from seclog.operators.lookup import MAX_BROADCAST_BYTES, left_lookup, measured
from seclog.session import materialize

PLACE = ["latitude", "longitude", "city"]
#: Keys of IPv4 addresses, as mapped into the other family, start with this.
IPV4_PREFIX = "00000000000000000000ffff"
_DIGITS, _UPSIDE_DOWN = "0123456789abcdef", "fedcba9876543210"
#: Bytes of a row beside its texts, in a hash table.
ROW_BYTES = 100
#: Making prefixes longer may add this share of the table's rows, or this many rows to a small one.
MORE_SHARE, MORE_ROWS = 0.25, 4096


def family_key(key: Column) -> Column:
    """``4`` and 8 digits, or ``6`` and 32 digits, of an address key."""
    return F.when(key.startswith(IPV4_PREFIX), F.concat(F.lit("4"), F.right(key, F.lit(8)))).otherwise(
        F.concat(F.lit("6"), key))


def _bound(ranges: DataFrame, name: str) -> Column:
    if ranges.schema[name].dataType.simpleString() == "string":
        return address_key(F.col(name))
    return F.concat(F.lit(IPV4_PREFIX), F.lpad(F.lower(F.hex(F.col(name).cast("bigint"))), 8, "0"))


def _digit(key: Column, at: Column) -> Column:
    return F.instr(F.lit(_DIGITS), F.substring(key, at, F.lit(1))) - 1


def _children(head: Column, allowed) -> Column:
    """``head`` with each allowed digit behind it."""
    every = F.array(*[F.lit(d) for d in range(16)])
    return F.transform(F.filter(every, allowed), lambda d: F.concat(head, F.substring(F.lit(_DIGITS), d + 1, F.lit(1))))


def prefixes_of(lo: Column, hi: Column) -> Column:
    """The fewest prefixes of whole digits that cover all keys from ``lo`` to ``hi``, both of one length.

    With the first digit in which the two differ at k: below ``lo`` what follows its digits, below ``hi`` what
    stands before its digits, and between them whole digits at k. Zeros at the end of ``lo`` and f's at the
    end of ``hi`` need no digits of their own.
    """
    places = F.sequence(F.lit(1), F.length(lo))
    common = F.size(F.filter(places, lambda j: F.substring(lo, F.lit(1), j) == F.substring(hi, F.lit(1), j)))
    # the family's own digit is not one of the address
    start = F.greatest(F.length(F.regexp_replace(lo, "(?<!^)0+$", "")), F.lit(1))
    end = F.greatest(F.length(F.regexp_replace(hi, "f+$", "")), F.lit(1))

    def cut(x: Column) -> Column:
        k, a, b = x["k"], F.greatest(x["a"], x["k"]), F.greatest(x["b"], x["k"])

        def left(n):
            return F.substring(lo, F.lit(1), n)

        def right(n):
            return F.substring(hi, F.lit(1), n)

        down = lambda end: F.filter(places, lambda j: (j > k) & (j <= end))
        pieces = F.concat(
            F.array(left(a)), F.array(right(b)),
            _children(left(k - 1), lambda d: (d > _digit(lo, k)) & (d < _digit(hi, k))),
            F.flatten(F.transform(down(a), lambda j: _children(left(j - 1), lambda d: d > _digit(lo, j)))),
            F.flatten(F.transform(down(b), lambda j: _children(right(j - 1), lambda d: d < _digit(hi, j)))),
        )
        whole = (x["a"] < k) & (x["b"] < k)
        return F.when(whole, F.array(left(k - 1))).otherwise(pieces)

    return bound(F.struct((common + 1).alias("k"), start.alias("a"), end.alias("b")), cut)


def cut_ranges(ranges: DataFrame) -> DataFrame:
    """``prefix, place``: every range's prefixes, with what decides between ranges at the front of ``place``.

    Ranges with a bound that is no address, or that end before they start, are left out.
    """
    keyed = ranges.select(
        _bound(ranges, "ip_lo").alias("lo"), _bound(ranges, "ip_hi").alias("hi"),
        F.col("latitude").cast("double"), F.col("longitude").cast("double"), "city",
    ).where("lo <= hi")
    four = F.col("lo").startswith(IPV4_PREFIX) & F.col("hi").startswith(IPV4_PREFIX)

    def own(key: str) -> Column:
        return F.when(four, family_key(F.col(key))).otherwise(F.concat(F.lit("6"), F.col(key)))

    place = F.struct(F.col("lo").alias("begin"), F.translate("hi", _DIGITS, _UPSIDE_DOWN).alias("narrow"), *PLACE)
    keyed = keyed.select(own("lo").alias("lo"), own("hi").alias("hi"), place.alias("place"))
    return keyed.select(F.explode(prefixes_of(F.col("lo"), F.col("hi"))).alias("prefix"), "place")


def longer_prefixes(rows_of: dict[tuple[str, int], int]) -> dict[tuple[str, int], int]:
    """(family, length) of prefixes -> the length they are given; few lengths are left.

    A length whose prefixes, made as long as the next, stay a small share of the table gives way to it.
    """
    spare = max(MORE_ROWS, int(MORE_SHARE * sum(rows_of.values())))
    given: dict[tuple[str, int], int] = {}
    for family in sorted({f for f, _ in rows_of}):
        lengths, waiting, rows = sorted(n for f, n in rows_of if f == family), [], 0
        for n, following in zip(lengths, [*lengths[1:], None]):
            waiting.append(n)
            rows += rows_of[family, n]
            grown = rows * 16 ** (following - n) if following else None
            if grown is not None and grown <= spare:
                spare, rows = spare - (grown - rows), grown
                continue
            given.update({(family, w): n for w in waiting})
            waiting, rows = [], 0
    return given


@dataclass(frozen=True)
class GeoTable:
    """``prefix, place`` of a range table, kept in the shared folder, its prefixes' lengths, and about its bytes."""

    prefixes: DataFrame
    lengths: tuple[int, ...]
    bytes: int


def prepare(ranges: DataFrame) -> GeoTable:
    """A range table made ready once, for many uses: every micro-batch of a stream, say.

    A row per family and length comes to the driver.
    """
    cut = cut_ranges(ranges)
    family, length = F.substring("prefix", 1, 1), F.length("prefix")
    size = F.octet_length("prefix") + F.coalesce(F.octet_length("place.city"), F.lit(0)) + ROW_BYTES
    counted = {(r.family, r.length): (r.n, r.size) for r in cut.groupBy(
        family.alias("family"), length.alias("length")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(size).alias("size")).collect()}
    given = longer_prefixes({k: n for k, (n, _) in counted.items()})
    more = {k: n for k, n in given.items() if n > k[1]}
    if more:
        missing = F
        for (f, n), longer in more.items():
            missing = missing.when((family == f) & (length == n), longer - n)
        tails = F.transform(
            F.sequence(F.lit(0), F.expr("shiftleft(1L, 4 * missing) - 1")),
            lambda n: F.right(F.concat(F.repeat(F.lit("0"), F.lit(32)), F.lower(F.hex(n))), F.col("missing")))
        ends = F.when(F.col("missing") > 0, tails).otherwise(F.array(F.lit("")))
        cut = cut.withColumn("missing", F.coalesce(missing, F.lit(0))).select(
            F.col("prefix").alias("head"), "place", F.explode(ends).alias("tail")).select(
            F.concat("head", "tail").alias("prefix"), "place")
    best = cut.groupBy("prefix").agg(F.max("place").alias("place"))
    total = sum(size * 16 ** (given[k] - k[1]) for k, (_, size) in counted.items())
    return GeoTable(materialize(best), tuple(sorted(set(given.values()))), total)


def place_inline(
    df: DataFrame, table: GeoTable, prefix: str, column: str, skip_private: bool = False,
    max_range_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """A left join per length of prefix. Also runs on a stream, with a table of any size: beyond
    ``max_range_bytes`` the joins go by shuffle."""
    key = family_key(address_key(F.col(column)))
    if skip_private:
        key = F.when(~is_private(F.col(column)), key)
    rows, small = df.withColumn("__pos", key), table.bytes <= max_range_bytes
    for n in table.lengths:
        named = table.prefixes.where(F.length("prefix") == n).select(
            F.col("prefix").alias("__prefix"), F.col("place").alias(f"__place{n}"))
        rows = rows.join(F.broadcast(named) if small else named,
                         F.substring("__pos", 1, n) == F.col("__prefix"), "left").drop("__prefix")
    hits = [F.col(f"__place{n}") for n in table.lengths]
    kind = table.prefixes.schema["place"].dataType
    best = F.greatest(*hits) if len(hits) > 1 else hits[0] if hits else F.lit(None).cast(kind)
    placed = rows.withColumn("__place", best)
    return placed.withColumns({f"{prefix}_{c}": F.col(f"__place.{c}") for c in PLACE}).drop(
        "__pos", "__place", *[f"__place{n}" for n in table.lengths])


def locate(addresses: DataFrame, table: GeoTable) -> DataFrame:
    """Place of each distinct address in column ``ip``; addresses outside all ranges are left out."""
    asked = addresses.select("ip", family_key(address_key(F.col("ip"))).alias("pos")).where("pos IS NOT NULL")
    own = [F.when(F.length("pos") >= n, F.substring("pos", 1, n)) for n in table.lengths]
    asked = asked.select("ip", F.explode(F.array_compact(F.array(*own)) if own else F.array().cast("array<string>"))
                         .alias("prefix"))
    best = asked.join(table.prefixes, "prefix").groupBy("ip").agg(F.max("place").alias("place"))
    return best.select("ip", *[F.col(f"place.{c}").alias(c) for c in PLACE])


def locate_columns(
    df: DataFrame, table: GeoTable, columns: list[str], skip_private: bool = False
) -> tuple[DataFrame, int]:
    """Places of all distinct addresses in several columns, computed once, and their bytes."""
    addresses = df.select(
        F.explode(F.array(*[F.col(c) for c in columns])).alias("ip")
    ).where("ip IS NOT NULL")
    addresses = addresses.distinct()
    if skip_private:
        addresses = addresses.where(~is_private(F.col("ip")))
    return measured(locate(addresses, table))


def geo_enrich(
    df: DataFrame,
    ranges: DataFrame | GeoTable,
    columns: dict[str, str],
    *,
    skip_private: bool = False,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    max_range_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Add latitude, longitude and city for each address column.

    ``columns`` maps a prefix to an address column: ``{"orig": "id_orig_h"}`` adds
    ``orig_latitude, orig_longitude, orig_city``. Unknown addresses get NULL. A range table
    that is not prepared is prepared here. Streams are placed inline.
    """
    table = ranges if isinstance(ranges, GeoTable) else prepare(ranges)
    if df.isStreaming or table.bytes <= max_range_bytes:
        for prefix, column in columns.items():
            df = place_inline(df, table, prefix, column, skip_private, max_range_bytes)
        return df
    places, size = locate_columns(df, table, list(columns.values()), skip_private)

    def add(frame: DataFrame, item: tuple[str, str]) -> DataFrame:
        prefix, column = item
        named = places.select("ip", *[F.col(c).alias(f"{prefix}_{c}") for c in PLACE])
        return left_lookup(
            frame, named, column, "ip", max_broadcast_bytes=max_broadcast_bytes, lookup_bytes=size, keys_from=df
        )

    return reduce(add, columns.items(), df)


def geo_unknown(df: DataFrame, prefixes: list[str]) -> DataFrame:
    """The geo columns as NULL, where no range table is at hand."""
    kinds = {"latitude": "double", "longitude": "double", "city": "string"}
    return df.withColumns({
        f"{p}_{c}": F.lit(None).cast(kind) for p in prefixes for c, kind in kinds.items()
    })
