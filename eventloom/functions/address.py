"""IPv4 addresses as numbers, IPv6 addresses as 32 hex digits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX_BITS = 16
PREFIX_SIZE = 1 << PREFIX_BITS


def ipv4_number(address: Column) -> Column:
    """Dotted address as BIGINT; NULL when it is not a valid IPv4 address."""
    parts = F.split(address, r"\.")
    octets = [F.get(parts, F.lit(i)) for i in range(4)]
    valid = F.size(parts) == 4
    total = F.lit(0).cast("bigint")
    for octet in octets:
        number = octet.try_cast("int")
        valid = valid & octet.rlike(r"^[0-9]{1,3}\z") & (number <= 255)
        total = total * 256 + number
    return F.when(valid, total)


def prefix_of(number: Column) -> Column:
    return F.shiftright(number, PREFIX_BITS)


HEX = "0123456789abcdef"
# Fixed value: IPv6 addresses that stand for IPv4 ones begin like this.
MAPPED = "0" * 20 + "f" * 4


def ipv6_hex(address: Column) -> Column:
    """32 lower-case hex digits, which sort like the address; NULL when it is not valid.

    One `::` stands for at least one group of zeros; the last two groups may be
    written as an IPv4 address. Zones are not part of an address.
    """

    def groups_of(side: Column) -> Column:
        none = F.array().cast("array<string>")
        return F.when(F.coalesce(side, F.lit("")) == "", none).otherwise(F.split(side, ":"))

    def joined(parts: Column) -> Column:
        """Digits of the two sides of `::`; the second one may be missing."""
        first, second, sides = parts["first"], parts["second"], parts["sides"]
        missing = F.lit(8) - F.size(first) - F.size(second)
        zeros = F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)))
        fits = (sides == 1) & (missing == 0) | (sides == 2) & (missing >= 1)
        return _bound(
            F.concat(first, zeros, second),
            lambda every: F.when(
                fits & F.forall(every, lambda group: group.rlike(r"^[0-9a-f]{1,4}\z")),
                F.array_join(F.transform(every, lambda group: F.lpad(group, 4, "0")), ""),
            ),
        )

    def plain(text: Column, dotted: Column) -> Column:
        """Without the IPv4 form of the last two groups."""
        pair = _bound(
            F.lpad(F.lower(F.hex(ipv4_number(dotted))), 8, "0"),
            lambda number: F.concat(F.substring(number, 1, 4), F.lit(":"), F.substring(number, 5, 4)),
        )
        before = F.left(text, F.length(text) - F.length(dotted))
        return F.when(text.contains("."), F.concat(before, pair)).otherwise(text)

    ending = r":([0-9]{1,3}(?:\.[0-9]{1,3}){3})\z"
    return _bound(
        F.lower(address),
        lambda text: _bound(
            F.split(_bound(F.regexp_extract(text, ending, 1), lambda dotted: plain(text, dotted)), "::"),
            lambda sides: _bound(
                F.struct(
                    groups_of(F.get(sides, F.lit(0))).alias("first"),
                    groups_of(F.get(sides, F.lit(1))).alias("second"),
                    F.size(sides).alias("sides"),
                ),
                joined,
            ),
        ),
    )


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that stands in the expression once, however often `body` reads it.

    Otherwise every step would copy the ones before it, and the plan would outgrow the driver.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ipv6_prefix(digits: Column, bits: int) -> Column:
    """The first bits of an address in hex, the rest of the last digit as zeros."""
    whole, rest = divmod(bits, 4)
    if not rest:
        return F.substring(digits, 1, whole)
    mask = 16 - (16 >> rest)
    kept = "".join(HEX[i & mask] for i in range(16))
    return F.concat(
        F.substring(digits, 1, whole), F.translate(F.substring(digits, whole + 1, 1), HEX, kept)
    )


def mapped_number(digits: Column) -> Column:
    """The IPv4 number that an IPv6 address stands for, or NULL."""
    number = lambda d: F.conv(F.substring(d, 25, 8), 16, 10).cast("bigint")
    return _bound(digits, lambda d: F.when(F.substring(d, 1, 24) == MAPPED, number(d)))


def unmapped(digits: Column) -> Column:
    """The digits of an address that does not stand for an IPv4 one, or NULL."""
    return _bound(digits, lambda d: F.when(F.substring(d, 1, 24) != MAPPED, d))
