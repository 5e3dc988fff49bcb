"""Internet addresses as column expressions: IPv4, IPv6 and mapped ones, their normal text, and networks."""

from __future__ import annotations

import ipaddress

import pyspark.sql.functions as F
from pyspark.sql import Column

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4 = rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"
Network = ipaddress.IPv4Network | ipaddress.IPv6Network


def let(value: Column, f) -> Column:
    """f(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _v4_words(text: Column) -> Column:
    return let(F.transform(F.split(text, r"\."), lambda o: o.cast("int")), lambda o: F.array(o[0] * 256 + o[1], o[2] * 256 + o[3]))


def _v6_words(text: Column) -> Column:
    fields = lambda half: F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))

    def filled(both: Column) -> Column:
        n = F.size(both["l"]) + F.size(both["r"])
        zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - n).cast("int"))
        return F.when(both["gap"] & (n <= 7), F.concat(both["l"], zeros, both["r"])).when(~both["gap"] & (n == 8), both["l"])

    def halves(h: Column) -> Column:
        gap = F.size(h) == 2
        right = F.when(gap, fields(F.try_element_at(h, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(h) <= 2, let(F.struct(fields(h[0]).alias("l"), right.alias("r"), gap.alias("gap")), filled))

    words = let(F.split(text, "::"), halves)
    return let(words, lambda w: F.when(F.forall(w, lambda x: x.rlike("^[0-9a-fA-F]{1,4}$")), F.transform(w, lambda x: F.conv(x, 16, 10).cast("int"))))


def words(text: Column) -> Column:
    """The 16-bit words of an address: two of an IPv4 one and of one mapped into IPv6, eight of another IPv6 one; null for what isn't one, and with a zone."""

    def parsed(t: Column) -> Column:
        tail = F.regexp_extract(t, r":([0-9.]+)$", 1)
        dotted = F.when(t.contains("."), F.when(tail.rlike(V4), let(_v4_words(tail), lambda w: F.concat(F.regexp_extract(t, r"^(.*:)[0-9.]+$", 1), F.lower(F.hex(w[0])), F.lit(":"), F.lower(F.hex(w[1])))))).otherwise(t)
        six = let(dotted, _v6_words)
        mapped = lambda w: F.forall(F.slice(w, 1, 5), lambda x: x == 0) & (w[5] == 65535)
        return F.when(t.contains(":"), let(six, lambda w: F.when(mapped(w), F.slice(w, 7, 2)).otherwise(w))).when(t.rlike(V4), _v4_words(t))

    return let(F.regexp_replace(text, r"^\s+|\s+$", ""), parsed)


def address_text(of: Column) -> Column:
    """The normal text of an address given by its words: lower case, the longest run of zeros (the first, from two words on) written ::."""

    def six(w: Column) -> Column:
        mask = F.array_join(F.transform(w, lambda x: F.when(x == 0, "0").otherwise("x")), "")
        hexed = F.transform(w, lambda x: F.lower(F.hex(x)))

        def shortened(run: Column) -> Column:
            left = F.slice(run["hexed"], F.lit(1), run["at"] - 1)
            right = F.slice(run["hexed"], run["at"] + run["n"], F.lit(8))
            return F.when(run["n"] < 2, F.array_join(run["hexed"], ":")).otherwise(F.concat(F.array_join(left, ":"), F.lit("::"), F.array_join(right, ":")))

        longest = lambda m: F.array_max(F.transform(F.split(m, "x"), F.length))
        placed = lambda r: F.struct(r["n"].alias("n"), F.position(F.repeat(F.lit("0"), r["n"]), r["mask"]).alias("at"), hexed.alias("hexed"))
        found = let(mask, lambda m: let(F.struct(m.alias("mask"), longest(m).alias("n")), placed))
        return let(found, shortened)

    four = lambda w: F.concat_ws(".", *[F.floor(w[k] / 256).cast("string") if high else (w[k] % 256).cast("string") for k in (0, 1) for high in (True, False)])
    return let(of, lambda w: F.when(F.size(w) == 2, four(w)).when(F.size(w) == 8, six(w)))


def normal(text: Column) -> Column:
    """An address in its normal text; null for what isn't one."""
    return address_text(words(text))


def within(of: Column, network: Network) -> Column:
    """Whether an address given by its words is of the network; false for null."""
    count, bits, number = network.max_prefixlen // 16, network.prefixlen, int(network.network_address)
    out = F.size(of) == count
    for k in range(count):
        shift = max(0, 16 * (k + 1) - bits)
        if shift < 16:
            out = out & (F.shiftright(F.get(of, F.lit(k)), shift) == (number >> (16 * (count - 1 - k)) & 0xFFFF) >> shift)
    return F.coalesce(out, F.lit(False))
