"""Addresses and ports."""

from __future__ import annotations

from functools import reduce
from ipaddress import ip_network
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from seclog import fixed_values as fv
from seclog.functions.text import bound


def is_ipv4(address: Column) -> Column:
    return F.coalesce(address.rlike(fv.IPV4), F.lit(False))


def is_ip(address: Column) -> Column:
    return is_ipv4(address) | F.coalesce(address.rlike(fv.IPV6), F.lit(False))


def ipv4_number(address: Column) -> Column:
    """Address as a whole number, NULL where it is no IPv4 address."""
    a, b, c, d = [
        F.split_part(address, F.lit("."), F.lit(n)).try_cast("bigint") for n in range(1, 5)
    ]
    return F.when(is_ipv4(address), a * 16777216 + b * 65536 + c * 256 + d)


def address_key(address: Column) -> Column:
    """32 hex digits in the order of the addresses, for both families; IPv4 as mapped into IPv6.
    NULL where it is no address."""
    four = F.concat(F.lit("00000000000000000000ffff"), F.lpad(F.lower(F.hex(ipv4_number(address))), 8, "0"))
    whole = F.lower(address)
    # an IPv4 address at the end stands for two groups
    tail = F.element_at(F.split(whole, ":"), -1)
    number = ipv4_number(tail)
    groups = F.concat(F.lower(F.hex(F.floor(number / 65536))), F.lit(":"), F.lower(F.hex(number % 65536)))
    plain = F.when(tail.contains("."), F.concat(
        F.substring(whole, F.lit(1), F.length(whole) - F.length(tail)), groups)).otherwise(whole)

    def parts(text: Column) -> Column:
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))

    def six(text: Column) -> Column:
        sides = F.split(text, "::", -1)
        left, right = parts(sides[0]), parts(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
        missing = F.lit(8) - F.size(left) - F.size(right)
        short = F.size(sides) == 2
        every = F.concat(left, F.array_repeat(F.lit("0"), F.when(short, F.greatest(missing, F.lit(0))).otherwise(0)), right)
        fits = (F.size(every) == 8) & (F.size(sides) <= 2) & (~short | (missing >= 1)) & F.forall(
            every, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(fits, F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    return F.when(is_ipv4(address), four).when(address.contains(":"), bound(plain, six))


def is_private(address: Column) -> Column:
    networks = [ip_network(n) for n in fv.PRIVATE_NETWORKS]

    def inside(number: Column) -> Column:
        return reduce(or_, [
            number.between(int(n.network_address), int(n.broadcast_address)) for n in networks
        ])

    return F.coalesce(bound(ipv4_number(address), inside), F.lit(False))


def _service_map(services: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in services.items() for x in pair])


def _services(ports: Column, services: dict[str, str]) -> Column:
    """Names of the listed ports that have one, in order."""
    named = F.transform(ports, lambda p: F.try_element_at(_service_map(services), p))
    return F.filter(named, lambda s: s.isNotNull())


def traffic_class(tcp_ports: Column, udp_ports: Column) -> Column:
    """Service of a packet from its port lists.

    A priority service (web or shell) wins, the last one if there are several; else the
    first known TCP service, else the first known UDP service.
    """
    tcp = _services(tcp_ports, fv.TCP_SERVICES)
    urgent = F.filter(tcp, lambda s: s.isin(fv.PRIORITY_SERVICES))
    return F.coalesce(
        F.try_element_at(urgent, F.lit(-1)),
        F.try_element_at(tcp, F.lit(1)),
        F.try_element_at(_services(udp_ports, fv.UDP_SERVICES), F.lit(1)),
        F.lit(fv.UNCLASSIFIED_TRAFFIC),
    )


def unusual_port(port_text: Column) -> Column:
    """The port of interest in ``a`` or ``a,b``: the second, unless the first is a web port."""
    first = F.split_part(port_text, F.lit(","), F.lit(1))
    second = F.split_part(port_text, F.lit(","), F.lit(2))
    chosen = F.when(
        port_text.contains(",") & ~first.isin(fv.WEB_PORT_TEXTS), second
    ).otherwise(first)
    return chosen.try_cast("double").try_cast("int")


def loss_severity(percent: Column) -> Column:
    low, high = fv.LOSS_BAND
    return (
        F.when(percent < low, "Low")
        .when(percent.between(low, high), "Medium")
        .when(percent > high, "High")
        .otherwise("Unknown")
    )
