"""Extension types as plain columns: ranges, network addresses, arrays, text vectors."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.names import free



def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: an expression that is named many times would be copied as often into the plan."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _of_two(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """A function of two values, each computed once."""

    @wraps(f)
    def run(a: Column, b: Column) -> Column:
        return _let(F.struct(a.alias("a"), b.alias("b")), lambda s: f(s["a"], s["b"]))

    return run


# --- ranges: struct<lower, upper, lower_inc, upper_inc, empty>; a null bound is infinite


def make_range(lower: Column, upper: Column, bounds: str = "[)") -> Column:
    """Lower above upper, or equal and not both inclusive, is empty."""
    return _normal(lower, upper, F.lit(bounds[0] == "["), F.lit(bounds[1] == "]"), F.lit(False))


def _normal(lower: Column, upper: Column, low_inc: Column, up_inc: Column, empty: Column) -> Column:
    given = F.struct(lower.alias("lower"), upper.alias("upper"), low_inc.alias("low_inc"), up_inc.alias("up_inc"), empty.alias("empty"))

    def told(g: Column) -> Column:
        lower, upper = g["lower"], g["upper"]
        none = F.coalesce(lower > upper, F.lit(False)) | F.coalesce((lower == upper) & ~(g["low_inc"] & g["up_inc"]), F.lit(False)) | g["empty"]
        return F.struct(
            F.when(~none, lower).alias("lower"), F.when(~none, upper).alias("upper"), (~none & g["low_inc"] & lower.isNotNull()).alias("lower_inc"), (~none & g["up_inc"] & upper.isNotNull()).alias("upper_inc"), none.alias("empty")
        )

    return _let(given, told)


def parse_range(text: Column, kind: str = "bigint") -> Column:
    """``[a,b)``, ``empty``; a blank bound is infinite; null if it is no range."""
    pattern = r"\A\s*([\[(])\s*([^,]*?)\s*,\s*([^,]*?)\s*([\])])\s*\z"

    def told(t: Column) -> Column:
        part = lambda i: F.regexp_extract(t, pattern, i)
        bound = lambda i: F.nullif(part(i), F.lit("")).try_cast(kind)
        empty = F.lower(F.trim(t)) == "empty"
        return F.when(t.rlike(pattern) | empty, _normal(bound(2), bound(3), part(1) == "[", part(4) == "]", empty))

    return _let(text, told)


def range_text(r: Column) -> Column:
    def told(r: Column) -> Column:
        body = F.concat(F.when(r["lower_inc"], "[").otherwise("("), F.coalesce(r["lower"].cast("string"), F.lit("")), F.lit(","), F.coalesce(r["upper"].cast("string"), F.lit("")), F.when(r["upper_inc"], "]").otherwise(")"))
        return F.when(r["empty"], "empty").when(~r["empty"], body)

    return _let(r, told)


@_of_two
def range_contains(r: Column, x: Column) -> Column:
    above = r["lower"].isNull() | (x > r["lower"]) | (r["lower_inc"] & (x == r["lower"]))
    below = r["upper"].isNull() | (x < r["upper"]) | (r["upper_inc"] & (x == r["upper"]))
    return ~r["empty"] & above & below


@_of_two
def range_contains_range(a: Column, b: Column) -> Column:
    """False if b is empty; infinite bounds only lie in infinite ones."""
    low = a["lower"].isNull() | F.coalesce((b["lower"] > a["lower"]) | ((b["lower"] == a["lower"]) & (a["lower_inc"] | ~b["lower_inc"])), F.lit(False))
    up = a["upper"].isNull() | F.coalesce((b["upper"] < a["upper"]) | ((b["upper"] == a["upper"]) & (a["upper_inc"] | ~b["upper_inc"])), F.lit(False))
    return ~a["empty"] & ~b["empty"] & low & up


@_of_two
def range_left(a: Column, b: Column) -> Column:
    """a << b: every value of a is below every value of b."""
    apart = (a["upper"] < b["lower"]) | ((a["upper"] == b["lower"]) & ~(a["upper_inc"] & b["lower_inc"]))
    return ~a["empty"] & ~b["empty"] & F.coalesce(apart, F.lit(False))


@_of_two
def range_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1: empty first, then by lower bound (infinite first, inclusive before exclusive), then by upper bound (infinite last)."""
    low = lambda r: F.struct(~r["empty"], r["lower"].isNotNull(), r["lower"], ~r["lower_inc"])
    up = lambda r: F.struct(r["upper"].isNull(), r["upper"], r["upper_inc"])
    x, y = F.struct(low(a), up(a)), F.struct(low(b), up(b))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(x < y, -1).when(x > y, 1).otherwise(0))


def range_right(a: Column, b: Column) -> Column:
    return range_left(b, a)


@_of_two
def range_overlaps(a: Column, b: Column) -> Column:
    return ~a["empty"] & ~b["empty"] & ~range_left(a, b) & ~range_left(b, a)


@_of_two
def range_adjacent(a: Column, b: Column) -> Column:
    """No value between them and none in both: one bound shared, held by one of them."""
    meet = lambda x, y: F.coalesce((x["upper"] == y["lower"]) & (x["upper_inc"] != y["lower_inc"]), F.lit(False))
    return ~a["empty"] & ~b["empty"] & (meet(a, b) | meet(b, a))


@_of_two
def range_intersection(a: Column, b: Column) -> Column:
    lower = F.when(a["lower"].isNull(), b["lower"]).when(b["lower"].isNull(), a["lower"]).otherwise(F.greatest(a["lower"], b["lower"]))
    upper = F.when(a["upper"].isNull(), b["upper"]).when(b["upper"].isNull(), a["upper"]).otherwise(F.least(a["upper"], b["upper"]))
    holds = lambda r, x, side: r[side].isNull() | (r[side] != x) | r[f"{side}_inc"]
    return _normal(lower, upper, holds(a, lower, "lower") & holds(b, lower, "lower"), holds(a, upper, "upper") & holds(b, upper, "upper"), a["empty"] | b["empty"])


@_of_two
def range_union(a: Column, b: Column) -> Column:
    """Null if the two neither overlap nor touch."""
    lower = F.when(a["lower"].isNotNull() & b["lower"].isNotNull(), F.least(a["lower"], b["lower"]))
    upper = F.when(a["upper"].isNotNull() & b["upper"].isNotNull(), F.greatest(a["upper"], b["upper"]))
    has = lambda r, x, side: F.coalesce((r[side] == x) & r[f"{side}_inc"], F.lit(False))
    both = _normal(lower, upper, has(a, lower, "lower") | has(b, lower, "lower"), has(a, upper, "upper") | has(b, upper, "upper"), F.lit(False))
    return F.when(a["empty"], b).when(b["empty"], a).when(range_overlaps(a, b) | range_adjacent(a, b), both)


# --- network addresses: text as given; a key of 32 hexadecimal digits orders both families and masks as one number


def host(inet: Column) -> Column:
    return F.substring_index(inet, "/", 1)


def is_ip6(inet: Column) -> Column:
    return inet.contains(":")


def mask_length(inet: Column) -> Column:
    given = F.try_element_at(F.split(inet, "/"), F.lit(2)).try_cast("int")
    return F.coalesce(given, F.when(is_ip6(inet), 128).otherwise(32))


def _ip4_key(text: Column) -> Column:
    """Eight digits; null unless there are four octets up to 255."""

    def told(octets: Column) -> Column:
        fine = (F.size(octets) == 4) & F.forall(octets, lambda x: F.coalesce(x.between(0, 255), F.lit(False)))
        return F.when(fine, F.array_join(F.transform(octets, lambda x: F.lower(F.lpad(F.hex(x.cast("bigint")), 2, "0"))), ""))

    return F.when(text.rlike(r"\A\d{1,3}(\.\d{1,3}){3}\z"), _let(F.transform(F.split(text, r"\."), lambda x: x.try_cast("int")), told))


_MAPPED = "0" * 20 + "f" * 4
_GROUPS6 = r"\A(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?)\z"


def _ip6_key(text: Column) -> Column:
    """32 digits; ``::`` stands for the zero groups that are missing, and the last two groups may be an IPv4 address."""

    def plain(t: Column) -> Column:
        tail = F.regexp_extract(t, r"(\d+\.\d+\.\d+\.\d+)\z", 1)
        mixed = _let(tail, lambda four: F.concat(F.left(t, F.length(t) - F.length(four)), F.regexp_replace(_ip4_key(four), r"\A(....)", "$1:")))
        return F.when(t.contains("."), mixed).otherwise(t)

    def groups(side: Column) -> Column:
        return F.filter(F.split(F.coalesce(side, F.lit("")), ":"), lambda g: g != "")

    def told(p: Column) -> Column:
        sides = F.split(p, "::")
        both = F.struct(groups(F.try_element_at(sides, F.lit(1))).alias("a"), groups(F.try_element_at(sides, F.lit(2))).alias("b"))

        def joined(s: Column) -> Column:
            missing = 8 - F.size(s["a"]) - F.size(s["b"])
            whole = F.concat(s["a"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), s["b"])
            fine = F.when(p.contains("::"), missing >= 1).otherwise(F.lit(True))
            return F.when(fine, F.array_join(F.transform(whole, lambda g: F.lower(F.lpad(g, 4, "0"))), ""))

        return F.when(p.rlike(_GROUPS6), _let(both, joined))

    return _let(_let(text, plain), told)


def _length_fits(inet: Column) -> Column:
    return mask_length(inet).between(0, F.when(is_ip6(inet), 128).otherwise(32))


def inet_key(inet: Column) -> Column:
    """32 hexadecimal digits that order and compare addresses; IPv4 as ::ffff:a.b.c.d, null if it is no address."""
    key = lambda text: F.when(is_ip6(text), _ip6_key(text)).otherwise(F.concat(F.lit(_MAPPED), _ip4_key(text)))
    return _let(inet, lambda i: F.when(_length_fits(i), _let(host(i), key)))


def _address(inet: Column) -> Column:
    """What the functions below need of an address or block: key, bits (the prefix length counted in the key), len and ip6."""
    return F.struct(inet_key(inet).alias("key"), _bits(inet).alias("bits"), mask_length(inet).alias("len"), is_ip6(inet).alias("ip6"))


def inet_family(inet: Column) -> Column:
    """4 or 6; null if it is no address."""
    return F.when(inet_key(inet).isNotNull(), F.when(is_ip6(inet), 6).otherwise(4))


@_of_two
def inet_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1: IPv4 before IPv6, then by number."""

    def told(s: Column) -> Column:
        x, y = F.struct(s["a"]["ip6"], s["a"]["key"]), F.struct(s["b"]["ip6"], s["b"]["key"])
        return F.when(s["a"]["key"].isNotNull() & s["b"]["key"].isNotNull(), F.when(x < y, -1).when(x > y, 1).otherwise(0))

    return _let(F.struct(_address(a).alias("a"), _address(b).alias("b")), told)


def _bits(inet: Column, length: Column | None = None) -> Column:
    """The prefix length counted in the key."""
    n = mask_length(inet) if length is None else length
    return n + F.when(is_ip6(inet), 0).otherwise(96)


def _masked(key: Column, bits: Column, fill: str = "0") -> Column:
    """The first ``bits`` bits of a key, the others 0, or 1 for fill f."""

    def told(s: Column) -> Column:
        whole, part = F.floor(s["n"] / 4).cast("int"), (s["n"] % 4).cast("int")
        digit = F.conv(F.substring(s["k"], whole + 1, F.lit(1)), 16, 10).cast("int")
        mask = F.element_at(F.array(*map(F.lit, (0, 8, 12, 14))), part + 1)
        cut = digit.bitwiseAND(mask) if fill == "0" else digit.bitwiseOR(F.lit(15) - mask)
        middle = F.when(part > 0, F.lower(F.hex(cut.cast("bigint")))).otherwise("")
        return F.rpad(F.concat(F.left(s["k"], whole), middle), 32, fill)

    return _let(F.struct(key.alias("k"), bits.alias("n")), told)


def key_text(key: Column, ip6: Column) -> Column:
    """A key as text: dotted octets, or groups without leading zeros where the longest run of zero groups (the first of equal ones) is ``::``."""
    runs = F.array(*(F.lit(rf"\A(.*?)(?:\A|:)0(?::0){{{n - 1}}}(?:\z|:)(.*)\z") for n in range(8, 1, -1)))

    def six(k: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substring(k, i * 4 + 1, F.lit(4)), r"\A0{1,3}", ""))
        return F.aggregate(runs, F.array_join(groups, ":"), lambda text, run: F.when(text.contains("::"), text).otherwise(F.regexp_replace(text, run, F.lit("$1::$2"))))

    def told(s: Column) -> Column:
        octet = lambda i: F.conv(F.substring(s["k"], i, 2), 16, 10)
        return F.when(s["k"].isNotNull(), F.when(s["six"], six(s["k"])).otherwise(F.concat_ws(".", *(octet(i) for i in (25, 27, 29, 31)))))

    return _let(F.struct(key.alias("k"), ip6.alias("six")), told)


def network(cidr: Column) -> Column:
    return _let(_address(cidr), lambda c: key_text(_masked(c["key"], c["bits"]), c["ip6"]))


def broadcast_address(cidr: Column) -> Column:
    return _let(_address(cidr), lambda c: key_text(_masked(c["key"], c["bits"], "f"), c["ip6"]))


def supernet(cidr: Column, length: Column | None = None) -> Column:
    """The block of a shorter prefix that holds it; one bit shorter unless said."""

    def told(s: Column) -> Column:
        c, n = s["c"], s["n"]
        return F.when(n <= c["len"], F.concat(key_text(_masked(c["key"], c["bits"] - c["len"] + n), c["ip6"]), F.lit("/"), n))

    shorter = F.greatest(mask_length(cidr) - 1, F.lit(0)) if length is None else length
    return _let(F.struct(_address(cidr).alias("c"), shorter.alias("n")), told)


def _both_known(a: Column, b: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of two addresses of one family; false across families, null if one is no address."""
    told = lambda s: F.when(s["a"]["key"].isNotNull() & s["b"]["key"].isNotNull(), (s["a"]["ip6"] == s["b"]["ip6"]) & body(s["a"], s["b"]))
    return _let(F.struct(_address(a).alias("a"), _address(b).alias("b")), told)


def cidr_contains(cidr: Column, inet: Column) -> Column:
    """cidr >> inet (or a smaller block); false across families."""
    return _both_known(cidr, inet, lambda c, i: (i["bits"] >= c["bits"]) & (_masked(c["key"], c["bits"]) == _masked(i["key"], F.least(c["bits"], i["bits"]))))


def cidr_overlaps(a: Column, b: Column) -> Column:
    def told(x: Column, y: Column) -> Column:
        n = F.least(x["bits"], y["bits"])
        return _masked(x["key"], n) == _masked(y["key"], n)

    return _both_known(a, b, told)


def _in_any(inet: Column, *blocks: str) -> Column:
    """Whether an address, whatever its prefix length, lies in one of some fixed blocks."""

    def told(i: Column) -> Column:
        out = F.lit(False)
        for net in map(ipaddress.ip_network, blocks):
            key = net.network_address.packed.hex() if net.version == 6 else _MAPPED + net.network_address.packed.hex()
            bits = net.prefixlen + (0 if net.version == 6 else 96)
            out = out | ((i["ip6"] == F.lit(net.version == 6)) & (_masked(i["key"], F.lit(bits)) == key))
        return F.when(i["key"].isNotNull(), out)

    return _let(_address(inet), told)


def is_private(inet: Column) -> Column:
    return _in_any(inet, "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fc00::/7")


def is_loopback(inet: Column) -> Column:
    return _in_any(inet, "127.0.0.0/8", "::1/128")


def is_multicast(inet: Column) -> Column:
    return _in_any(inet, "224.0.0.0/4", "ff00::/8")


def is_link_local(inet: Column) -> Column:
    return _in_any(inet, "169.254.0.0/16", "fe80::/10")


def cidr_join(left: DataFrame, ip: str, right: DataFrame, cidr: str | list[str], how: str = "inner") -> DataFrame:
    """Rows whose address lies in a block, or in one of several blocks of a row: an equi-join on (family, prefix length, masked address).

    Each address is spread over the prefix lengths that occur (162 at most), so
    no pair is compared that doesn't match.  With how="left" an address outside
    all blocks stays, once, with nulls.
    """
    blocks_of = [cidr] if isinstance(cidr, str) else list(cidr)
    row, block, own, size, net, lengths, at, masked, hits = free("row", "block", "own", "size", "net", "lengths", "at", "masked", "hits", of=(left, right))
    names, others = left.columns, right.columns
    if set(names) & set(others):
        raise ValueError(f"columns of both sides: {sorted(set(names) & set(others))}")
    wide = right.withColumn(own, F.monotonically_increasing_id()) if len(blocks_of) > 1 else right.withColumn(own, F.lit(0))
    blocks = wide.withColumn(block, F.explode(F.array(*map(F.col, blocks_of))) if len(blocks_of) > 1 else F.col(blocks_of[0]))
    blocks = blocks.where(inet_key(F.col(block)).isNotNull()).withColumns({size: F.when(is_ip6(F.col(block)), _bits(F.col(block)) + 1000).otherwise(_bits(F.col(block))), net: _masked(inet_key(F.col(block)), _bits(F.col(block)))})
    found = blocks.agg(F.collect_set(size).alias(lengths))  # one row of 162 numbers at most
    base = left.withColumn(row, F.monotonically_increasing_id())
    key, family = inet_key(F.col(ip)), F.when(is_ip6(F.col(ip)), 1000).otherwise(0)
    fits = F.filter(F.col(lengths), lambda n: (n >= family) & (n - family <= _bits(F.col(ip))) & ((n >= 1000) == is_ip6(F.col(ip))))
    spread = base.crossJoin(F.broadcast(found)).withColumn(at, F.explode_outer(F.when(key.isNotNull(), fits))).drop(lengths)
    spread = spread.withColumn(masked, F.when(F.col(at).isNotNull(), _masked(key, F.col(at) - family)))
    met = spread.join(blocks, (F.col(at) == F.col(size)) & (F.col(masked) == F.col(net)), "left" if how == "left" else "inner")
    if how == "left":
        mine = Window.partitionBy(row)  # at most a row for each length and block
        met = met.withColumns({hits: F.count(net).over(mine), size: F.row_number().over(mine.orderBy(at))})
        met = met.where(F.col(net).isNotNull() | ((F.col(hits) == 0) & (F.col(size) == 1)))
    if len(blocks_of) > 1:
        met = met.dropDuplicates([row, own])
    return met.select(*names, *others)


def mac_number(mac: Column) -> Column:
    return F.conv(F.regexp_replace(mac, "[:.-]", ""), 16, 10).cast("bigint")


def mac_text(mac: Column) -> Column:
    h = F.lpad(F.lower(F.regexp_replace(mac, "[:.-]", "")), 12, "0")
    return F.concat_ws(":", *(F.substring(h, i, 2) for i in range(1, 12, 2)))


def mac_is_multicast(mac: Column) -> Column:
    return F.shiftright(mac_number(mac), 40).bitwiseAND(1) == 1


def mac_is_broadcast(mac: Column) -> Column:
    return mac_number(mac) == (1 << 48) - 1


def mac_is_local(mac: Column) -> Column:
    return F.shiftright(mac_number(mac), 41).bitwiseAND(1) == 1


@_of_two
def mac_compare(a: Column, b: Column) -> Column:
    x, y = mac_number(a), mac_number(b)
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def mac_substring(mac: Column, start: int, length: int) -> Column:
    """SUBSTRING over the canonical text."""
    return F.substring(mac_text(mac), start, length)


# --- arrays


def parse_array(text: Column, kind: str = "int") -> Column:
    """``{1,2,3}``; blank tokens are dropped."""
    inner = F.regexp_extract(text, r"^\s*\{(.*)\}\s*$", 1)
    tokens = F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(tokens, lambda x: x.cast(kind))


def array_text(a: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("}"))


def element(a: Column, index: Column, lower: int = 1) -> Column:
    """The element at an index of an array whose first index is ``lower``; an error outside."""
    return F.element_at(a, index - lower + 1)


def array_slice(a: Column, first: int, last: int, step: int = 1, lower: int = 1) -> Column:
    part = F.slice(a, first - lower + 1, last - first + 1)
    return part if step == 1 else F.filter(part, lambda _, i: i % step == 0)


def array_contains_all(a: Column, b: Column) -> Column:
    return F.forall(b, lambda x: F.array_contains(a, x))


def array_contained_in(a: Column, b: Column) -> Column:
    """a <@ b."""
    return array_contains_all(b, a)


def array_equal(a: Column, b: Column) -> Column:
    return a == b


def array_bounds(a: Column, lower: int = 1) -> Column:
    """The first and last index."""
    return F.struct(F.lit(lower).alias("lower"), (F.size(a) + lower - 1).alias("upper"))


def array_avg(a: Column) -> Column:
    """Nulls don't count; null if there is no value."""
    known = F.filter(a, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known))


def find_element(a: Column, x: Column, lower: int = 1) -> Column:
    """The first index of a value, null if it isn't there."""
    at = F.array_position(a, x)
    return F.when(at > 0, (at + lower - 1).cast("int"))


def element_nd(a: Column, indexes: list[Column], bounds: list[tuple[int, int]]) -> Column:
    """The element of an n-dimensional array kept row by row; an error outside the bounds."""
    at, inside = F.lit(0), F.lit(True)
    for i, (lo, hi) in zip(indexes, bounds, strict=True):
        at = at * (hi - lo + 1) + (i - lo)
        inside = inside & i.between(lo, hi)
    return F.when(inside, F.element_at(a, at.cast("int") + 1)).otherwise(F.raise_error(F.lit("index outside the bounds")))


def slice_nd(a: Column, spans: list[tuple[int, int, int]], bounds: list[tuple[int, int]]) -> Column:
    """The elements whose index in each dimension is first, first + step, ... up to last; row by row."""
    places = [0]
    for (first, last, step), (lo, hi) in zip(spans, bounds, strict=True):
        if first < lo or last > hi:
            raise ValueError("a slice outside the bounds")
        places = [p * (hi - lo + 1) + i - lo for p in places for i in range(first, last + 1, step)]
    return F.transform(F.array(*(F.lit(p + 1) for p in places)), lambda p: F.element_at(a, p))


def array_sum(a: Column, zero: Column) -> Column:
    return F.aggregate(a, zero, lambda s, x: s + F.coalesce(x, zero))


# --- text vectors: array<struct<lexeme, position, weight>> in page order; the query as a tree


# Stop words, and suffixes that the stemmer takes off (with what it puts there), by language.
STOP_WORDS = {
    "simple": (),
    "english": tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()),
    "german": tuple("aber als am an auch auf aus bei das dem den der des die ein eine er es ist mit nicht oder sie und von zu".split()),
    "french": tuple("au aux ce ces dans de des du elle en et il la le les ne ou par pas pour que qui sur un une".split()),
}
_SUFFIXES = {
    "english": (("sses", "ss"), ("ies", "i"), ("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("ingly", ""), ("edly", ""), ("ing", ""), ("ed", ""), ("ly", ""), ("s", "")),
    "german": (("ungen", "ung"), ("heiten", "heit"), ("ern", ""), ("en", ""), ("er", ""), ("es", ""), ("e", "")),
    "french": (("issement", "iss"), ("ements", "e"), ("ement", "e"), ("eaux", "eau"), ("aux", "al"), ("es", ""), ("e", ""), ("s", "")),
}


def stem(word: Column, language: str = "simple") -> Column:
    """The first suffix that fits is replaced where three letters or more stay; a double s stays."""
    out: Column = word
    for suffix, put in reversed(_SUFFIXES.get(language, ())):
        fits = word.endswith(suffix) & (F.length(word) - len(suffix) >= 3)
        if suffix == "s":
            fits = fits & ~word.endswith("ss")
        out = F.when(fits, F.concat(F.left(word, F.length(word) - len(suffix)), F.lit(put))).otherwise(out)
    return out


def tsvector(text: Column, stop: tuple[str, ...] = (), language: str = "simple", weight: str = "D") -> Column:
    """Lexemes (words in lower case, stemmed by the language, without its stop words) with positions from 1 and a weight A to D."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    placed = F.transform(words, lambda w, i: F.struct(w.alias("lexeme"), (i + 1).alias("position"), F.lit(weight).alias("weight")))
    gone = (*stop, *STOP_WORDS[language])
    kept = F.filter(placed, lambda x: ~x["lexeme"].isin(*gone)) if gone else placed
    return kept if language == "simple" else F.transform(kept, lambda x: x.withField("lexeme", stem(x["lexeme"], language)))


def set_weight(vector: Column, weight: str) -> Column:
    return F.transform(vector, lambda x: x.withField("weight", F.lit(weight)))


def lexemes(docs: DataFrame, key: str, text: str, stop: tuple[str, ...] = ()) -> DataFrame:
    """(key, lexeme, positions): the rows of an inverted index."""
    rows = docs.select(key, F.explode(tsvector(F.col(text), stop)).alias("x")).select(key, "x.lexeme", "x.position")
    return rows.groupBy(key, "lexeme").agg(F.sort_array(F.collect_list("position")).alias("positions"))


def _positions(vector: Column, lexeme: str) -> Column:
    return F.transform(F.filter(vector, lambda x: x["lexeme"] == lexeme), lambda x: x["position"])


class TsQuery:
    """``a & b``, ``a | b``, ``!a``, ``a <-> b`` (or ``<n>``), parentheses."""

    def __init__(self, text: str):
        self._tokens = re.findall(r"<->|<\d+>|[&|!()]|[\w]+", text.lower())
        self.tree = self._or()
        if self._tokens:
            raise ValueError(f"unexpected {self._tokens[0]!r}")

    def _next(self, *wanted: str) -> bool:
        if self._tokens and self._tokens[0] in wanted:
            self._tokens.pop(0)
            return True
        return False

    def _or(self):
        tree = self._and()
        while self._next("|"):
            tree = ("|", tree, self._and())
        return tree

    def _and(self):
        tree = self._phrase()
        while self._next("&"):
            tree = ("&", tree, self._phrase())
        return tree

    def _phrase(self):
        tree = self._not()
        while self._tokens and re.fullmatch(r"<->|<\d+>", self._tokens[0]):
            sign = self._tokens.pop(0)
            tree = ("<>", tree, self._not(), 1 if sign == "<->" else int(sign[1:-1]))
        return tree

    def _not(self):
        if self._next("!"):
            return ("!", self._not())
        if self._next("("):
            tree = self._or()
            if not self._next(")"):
                raise ValueError("a parenthesis is open")
            return tree
        return self._tokens.pop(0)

    def nodes(self) -> int:
        count = lambda t: 1 if isinstance(t, str) else 1 + sum(count(x) for x in t[1:] if not isinstance(x, int))
        return count(self.tree)

    def rewritten(self, old: str, new: TsQuery) -> TsQuery:
        out = TsQuery.__new__(TsQuery)
        swap = lambda t: (new.tree if t == old else t) if isinstance(t, str) else tuple(swap(x) if i and not isinstance(x, int) else x for i, x in enumerate(t))
        out._tokens, out.tree = [], swap(self.tree)
        return out

    def words(self) -> list[str]:
        gather = lambda t: [t] if isinstance(t, str) else [] if t[0] == "!" else [w for x in t[1:] if not isinstance(x, int) for w in gather(x)]
        return gather(self.tree)


def to_tsquery(text: str) -> TsQuery:
    return TsQuery(text)


def plainto_tsquery(text: str) -> TsQuery:
    return TsQuery(" & ".join(re.findall(r"\w+", text)))


def phraseto_tsquery(text: str) -> TsQuery:
    return TsQuery(" <-> ".join(re.findall(r"\w+", text)))


def ts_matches(vector: Column, query: TsQuery) -> Column:
    return _let(vector, lambda v: _matched(v, query))


def _matched(vector: Column, query: TsQuery) -> Column:
    def places(t) -> Column:
        """Each operand once and by a hash set: the work grows with the text, not with its hits squared."""
        if isinstance(t, str):
            return _positions(vector, t)
        if t[0] != "<>":
            raise ValueError("a phrase is made of words")
        return F.array_intersect(places(t[2]), F.transform(places(t[1]), lambda p: p + t[3]))

    def holds(t) -> Column:
        if isinstance(t, str):
            return F.exists(vector, lambda x: x["lexeme"] == t)
        if t[0] == "!":
            return ~holds(t[1])
        if t[0] == "<>":
            return F.size(places(t)) > 0
        return holds(t[1]) & holds(t[2]) if t[0] == "&" else holds(t[1]) | holds(t[2])

    return holds(query.tree)


# What a hit of each weight counts.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


def _normalized(rank: Column, vector: Column, normalization: int) -> Column:
    """Bits: 1 divides by 1 + ln(length), 2 by the length, 8 by the number of lexemes, 16 by 1 + its ln, 32 gives rank / (rank + 1)."""
    n, different = F.size(vector), F.size(F.array_distinct(F.transform(vector, lambda x: x["lexeme"])))
    for bit, by in ((1, 1 + F.ln(F.greatest(n, F.lit(1)))), (2, F.greatest(n, F.lit(1))), (8, F.greatest(different, F.lit(1))), (16, 1 + F.ln(F.greatest(different, F.lit(1))))):
        rank = rank / by if normalization & bit else rank
    return rank / (rank + 1) if normalization & 32 else rank


def ts_rank(vector: Column, query: TsQuery, normalization: int = 0, weighted: bool = False) -> Column:
    """Occurrences of the query's words over all occurrences, or the sum of their weights."""
    words, total = sorted(set(query.words())), F.size(vector)
    hits = F.filter(vector, lambda x: x["lexeme"].isin(*words))
    if weighted:
        worth = F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))
        rank = F.aggregate(hits, F.lit(0.0), lambda s, x: s + worth[x["weight"]])
    else:
        rank = F.when(total > 0, F.size(hits) / total).otherwise(F.lit(0.0))
    return _normalized(rank, vector, normalization)


def with_synonyms(query: TsQuery, synonyms: dict[str, str]) -> TsQuery:
    """Each word that has synonyms becomes any of them or itself."""
    for word, others in synonyms.items():
        query = query.rewritten(word, TsQuery(" | ".join([word, *others.split()])))
    return query


def ts_headline(text: Column, query: TsQuery, start: str = "<b>", stop: str = "</b>") -> Column:
    words = "|".join(sorted(map(re.escape, set(query.words()))))
    return F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}])({words})(?![\p{{L}}\p{{N}}])", f"{start}$1{stop}")


def has_lexeme(vector: Column, lexeme: str) -> Column:
    return F.exists(vector, lambda x: x["lexeme"] == lexeme)


def ts_concat(a: Column, b: Column) -> Column:
    """``b`` after ``a``: its positions count on from the greatest of ``a``."""
    end = F.coalesce(F.array_max(F.transform(a, lambda x: x["position"])), F.lit(0))
    return F.concat(a, F.transform(b, lambda x: F.struct(x["lexeme"].alias("lexeme"), (x["position"] + end).alias("position"), x["weight"].alias("weight"))))


def ts_rank_cd(vector: Column, query: TsQuery) -> Column:
    """Cover density: the sum of 1 / gap over neighbouring hits of different query words."""
    hits = F.filter(vector, lambda x: x["lexeme"].isin(*sorted(set(query.words()))))
    after = F.slice(hits, 2, F.greatest(F.size(hits), F.lit(1)))
    pairs = F.filter(F.arrays_zip(hits.alias("a"), after.alias("b")), lambda p: p["b"].isNotNull() & (p["a"]["lexeme"] != p["b"]["lexeme"]))
    gaps = F.transform(pairs, lambda p: F.lit(1.0) / (p["b"]["position"] - p["a"]["position"]))
    return F.aggregate(gaps, F.lit(0.0), lambda total, x: total + x)


def query_tree(query: TsQuery) -> str:
    """The query as text with every operation in parentheses."""

    def shown(t) -> str:
        if isinstance(t, str):
            return t
        if t[0] == "!":
            return f"!{shown(t[1])}"
        sign = {"&": " & ", "|": " | ", "<>": f" <{t[3]}> " if len(t) > 3 else ""}[t[0]]
        return f"({shown(t[1])}{sign}{shown(t[2])})"

    return shown(query.tree)
