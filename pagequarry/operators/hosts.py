"""Hosts that must not be fetched: literal addresses in blocked networks, found by equal prefixes."""

import ipaddress
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.urls import BLOCKED_V4, BLOCKED_V6, V4_INSIDE_V6, V4_LAST_IN_V6

QUAD = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"


def _bits(number: Column, base: int, width: int) -> Column:
    return F.lpad(F.conv(number, base, 2), width, "0")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _v4_bits(host: Column) -> Column:
    def of(parts: Column) -> Column:
        return F.when(~F.exists(parts, lambda x: x.cast("int") > 255), F.array_join(F.transform(parts, lambda x: _bits(x, 10, 8)), ""))

    return _let(F.split(F.when(host.rlike(f"^{QUAD}$"), host), r"\."), of)


def _groups(halves: Column, k: int) -> Column:
    return _let(F.coalesce(F.get(halves, F.lit(k)), F.lit("")), lambda half: F.when(half == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(half, ":")))


def _v6_bits(long: Column) -> Column:
    """Of an address whose short tail, if any, is written in two groups."""

    def of(halves: Column) -> Column:
        def filled(sides: Column) -> Column:
            left, right = sides[0], sides[1]
            missing = 8 - F.size(left) - F.size(right)
            gap = F.when(F.size(halves) == 1, F.when(missing == 0, 0)).when((F.size(halves) == 2) & (missing >= 1), missing)
            return F.concat(left, F.array_repeat(F.lit("0"), gap), right)

        whole = _let(F.array(_groups(halves, 0), _groups(halves, 1)), filled)
        return _let(whole, lambda groups: F.when(F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(groups, lambda g: _bits(g, 16, 16)), "")))

    return _let(F.split(long, "::"), of)


def address_bits(host: Column) -> Column:
    """The 32 or 128 binary digits of a literal address, with or without brackets and zone; null for names and anything else."""

    def long_bits(long: Column) -> Column:
        def with_tail(tail: Column) -> Column:
            hexed = F.concat(F.conv(F.substring(tail, 1, 16), 2, 16), F.lit(":"), F.conv(F.substring(tail, 17, 16), 2, 16))
            return _v6_bits(F.concat(F.regexp_replace(long, f"{QUAD}$", ""), F.lower(hexed)))

        return F.when(long.rlike(f":{QUAD}$"), _let(_v4_bits(F.regexp_extract(long, f":({QUAD})$", 1)), with_tail)).otherwise(_v6_bits(long))

    def of(bare: Column) -> Column:
        return F.when(F.contains(bare, F.lit(":")), _let(F.regexp_replace(bare, "%.*$", ""), long_bits)).otherwise(_v4_bits(bare))

    return _let(F.lower(F.regexp_replace(F.trim(host), r"^\[|\]$", "")), of)


def _prefix(network) -> str:
    return format(int(network.network_address), f"0{network.max_prefixlen}b")[: network.prefixlen]


def _networks(nets: Iterable) -> set[tuple[int, str]]:
    """(digits of an address, prefix) of networks."""
    return {(n.max_prefixlen, _prefix(n)) for n in nets}


def blocked_networks() -> set[tuple[int, str]]:
    """All blocked prefixes: those of both kinds, and the blocked short addresses inside long ones in each form that carries them."""
    short = [ipaddress.ip_network(x) for x in BLOCKED_V4]
    return _networks([*short, *map(ipaddress.ip_network, BLOCKED_V6)]) | {(128, _prefix(ipaddress.ip_network(outer)) + _prefix(n)) for outer in V4_INSIDE_V6 for n in short}


def parse_allowed(allow: Sequence[str]) -> tuple[set[str], set[tuple[int, str]]]:
    """Allowed names, in lower case, and allowed prefixes; an entry with a slash that is no network counts for nothing."""
    names, nets = set(), []
    for entry in filter(None, (a.strip() for a in allow)):
        try:
            nets.append(ipaddress.ip_network(entry, strict=False))
        except ValueError:
            if "/" not in entry:
                names.add(entry.lower())
    return names, _networks(nets)


def _within(addresses: DataFrame, networks: set[tuple[int, str]]) -> DataFrame:
    """The hosts of (host, bits) that lie in one of the networks: an equal join on (digits, prefix), each address cut to the lengths that prefixes have."""
    spark = addresses.sparkSession
    lengths = F.array(*(F.struct(F.lit(d).alias("digits"), F.lit(n).alias("length")) for d, n in sorted({(d, len(p)) for d, p in networks})))
    cut = addresses.select("host", "bits", F.explode(F.filter(lengths, lambda x: x["digits"] == F.length("bits"))).alias("x"))
    cut = cut.select("host", F.col("x.digits").alias("digits"), F.expr("substring(bits, 1, x.length)").alias("prefix"))
    return cut.join(spark.createDataFrame(sorted(networks), "digits int, prefix string"), ["digits", "prefix"], "left_semi").select("host").distinct()


def filter_blocked_hosts(df: DataFrame, host: str, allow: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(kept, blocked): literal addresses inside a blocked network go, unless `allow` has the host by name, address or network; names and nulls stay.

    Different literals are looked up once each, by equal prefixes, so an allow-list may be long and hosts may repeat.
    """
    spark = df.sparkSession
    literal = df.select(F.col(host).cast("string").alias("host")).where("host is not null").distinct().withColumn("bits", address_bits(F.col("host"))).where("bits is not null")
    def last_digits(outers: Sequence[str]) -> DataFrame:
        """With the short addresses in which long ones of these networks end."""
        inside = F.lit(False)
        for p in (_prefix(ipaddress.ip_network(n)) for n in outers):
            inside = inside | (F.substring("bits", 1, len(p)) == p)
        return literal.unionByName(literal.where((F.length("bits") == 128) & inside).select("host", F.substring("bits", 97, 32).alias("bits")))

    bad = _within(last_digits(V4_LAST_IN_V6), blocked_networks())
    names, nets = parse_allowed(allow)
    if nets:
        bad = bad.join(_within(last_digits(V4_LAST_IN_V6[:1]), nets), "host", "left_anti")
    if names:
        bad = bad.join(spark.createDataFrame([(n,) for n in sorted(names)], "name string"), F.lower("host") == F.col("name"), "left_anti")
    marked = bad.withColumnRenamed("host", "__blocked")
    return df.join(marked, F.col(host) == F.col("__blocked"), "left_anti"), df.join(marked, F.col(host) == F.col("__blocked"), "left_semi")
