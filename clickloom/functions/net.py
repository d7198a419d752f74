"""IP address expressions.

Accepted grammar: IPv4 is four decimal octets without leading zeros. IPv6 is eight hexadecimal groups of one to four
digits, one ``::`` standing for at least one group, and optionally a dotted IPv4 tail in place of the last two groups.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.text import trimmed
from clickloom.plans.barrier import computed_once
from clickloom.plans.lookup import lookup_join
from clickloom.plans.sweep import covered_points
from clickloom.plans.workspace import staged

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_DOTTED = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_HEX = r"[0-9A-Fa-f]{1,4}"


def _ipv6_pattern() -> str:
    forms = [rf"(?:{_HEX}:){{7}}{_HEX}", rf"(?:{_HEX}:){{6}}{_DOTTED}"]
    for left in range(8):
        head = rf"{_HEX}(?::{_HEX}){{{left - 1}}}" if left else ""
        room = 7 - left
        tails = [rf"{_HEX}(?::{_HEX}){{0,{room - 1}}}"] if room else []
        if room >= 2:
            tails.append(rf"(?:{_HEX}:){{0,{room - 2}}}{_DOTTED}")
        tail = f"(?:{'|'.join(tails)})?" if tails else ""
        forms.append(f"{head}::{tail}")
    return rf"\A(?:{'|'.join(forms)})\z"


IPV4_PATTERN = rf"\A{_DOTTED}\z"
IPV6_PATTERN = _ipv6_pattern()

# Address ranges that are not public.
PRIVATE_RANGES = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fc00::/7")
RESERVED_RANGES = (
    "0.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "240.0.0.0/4",
    "::/128", "::1/128", "::ffff:0:0/96", "fe80::/10",
)
# Ranges a redirect target must not resolve to, besides the two lists above.
BLOCKED_RANGES = (
    "169.254.169.254/32", "169.254.0.0/16", "127.0.0.0/8", "fd00::/8", "fe80::/10", "::1/128",
)
NO_ADDRESS = "0.0.0.0"


def _has_colon(c: Column) -> Column:
    return F.coalesce(c.contains(":"), F.lit(False))


def is_ipv4(c: Column) -> Column:
    return F.coalesce(c.rlike(IPV4_PATTERN), F.lit(False))


def is_ipv6(c: Column) -> Column:
    return _has_colon(c) & c.rlike(IPV6_PATTERN)


def is_ip(c: Column) -> Column:
    return F.when(_has_colon(c), c.rlike(IPV6_PATTERN)).otherwise(is_ipv4(c))


def ipv4_number(c: Column) -> Column:
    """Address as an unsigned 32-bit number in a long, null for anything else."""
    octets = F.split(c, r"\.")
    value = sum((F.get(octets, F.lit(i)).try_cast("bigint") * F.lit(256 ** (3 - i)) for i in range(4)), F.lit(0))
    return F.when(is_ipv4(c), value)


def ipv4_digits(c: Column) -> Column:
    """Address as 8 hexadecimal digits, null for anything else."""
    return F.lower(F.lpad(F.hex(ipv4_number(c)), 8, "0"))


def _expanded(c: Column) -> Column:
    """Groups of a valid IPv6 text, each padded to four digits, the ``::`` written out.

    Every step uses the one before it once, so the expression stays small.
    """
    dotted = c.contains(".")
    tail = F.lpad(F.hex(ipv4_number(F.regexp_extract(c, rf"({_DOTTED})\z", 1))), 8, "0")
    head = F.regexp_replace(c, r"[0-9.]+\z", "")
    groups = F.when(dotted, F.concat(head, F.regexp_replace(tail, r"\A(.{4})", "$1:"))).otherwise(c)
    colons = F.length(c) - F.length(F.translate(c, ":", "")) + F.when(dotted, 1).otherwise(0)
    zeros = F.concat(F.repeat(F.lit(":0"), F.lit(8) - colons), F.lit(":"))
    full = F.replace(F.lower(groups), F.lit("::"), zeros)
    padded = F.concat(F.lit("0000"), F.replace(full, F.lit(":"), F.lit(":0000")))
    return F.regexp_replace(padded, r"[0-9a-f]*([0-9a-f]{4})(?::|\z)", "$1")


def ipv6_digits(c: Column) -> Column:
    """Address as 32 lower-case hexadecimal digits, so that text order is address order; null for anything else."""
    return F.when(is_ipv6(c), _expanded(c))


def _blocks(ranges: Sequence[str]) -> list[ipaddress.IPv4Network | ipaddress.IPv6Network]:
    """The entries with a slash that name a range; others match nothing."""
    found = []
    for entry in ranges:
        try:
            found += [ipaddress.ip_network(entry, strict=False)] if "/" in entry else []
        except ValueError:
            continue
    return found


def _ipv4_block_pattern(block: ipaddress.IPv4Network) -> str:
    """Range as a pattern over a valid address: whole octets, then the values of the octet the prefix cuts."""
    whole, rest = divmod(block.prefixlen, 8)
    octets = str(block.network_address).split(".")
    text = "".join(f"{o}\\." for o in octets[:whole]) if whole < 4 else "\\.".join(octets) + r"\z"
    if rest:
        low = int(octets[whole])
        text += f"(?:{'|'.join(str(v) for v in range(low, low + 2 ** (8 - rest)))})" + (r"\." if whole < 3 else r"\z")
    return text


def _ipv6_block_pattern(block: ipaddress.IPv6Network) -> str:
    """Range as a pattern over 32 digits."""
    whole, rest = divmod(block.prefixlen, 4)
    digits = f"{int(block.network_address):032x}"
    low = int(digits[whole], 16) if rest else 0
    return digits[:whole] + (f"[{''.join(f'{v:x}' for v in range(low, low + 2 ** (4 - rest)))}]" if rest else "")


def _ipv4_ranges(ranges: Sequence[str]) -> str | None:
    parts = [_ipv4_block_pattern(b) for b in _blocks(ranges) if b.version == 4]
    return rf"(?:{'|'.join(parts)})" if parts else None


def _ipv6_ranges(ranges: Sequence[str]) -> str | None:
    parts = [_ipv6_block_pattern(b) for b in _blocks(ranges) if b.version == 6]
    return rf"\A(?:{'|'.join(parts)})" if parts else None


def in_any_cidr(c: Column, ranges: Sequence[str], empty_admits: bool = True) -> Column:
    """Membership in any of a short list of ranges.

    The list becomes one pattern per address family, so a row costs one or two matches and no join. An entry without
    a slash means equality. An empty list admits everything unless told otherwise.
    """
    ranges = [r.strip() for r in ranges]
    if not ranges:
        return F.lit(empty_admits)
    v4, v6 = _ipv4_ranges(ranges), _ipv6_ranges(ranges)
    low = c.rlike(rf"\A(?={v4}){_DOTTED}\z") if v4 else F.lit(False)
    high = ipv6_digits(c).rlike(v6) if v6 else F.lit(False)
    hit = F.when(_has_colon(c), high).otherwise(low)
    single = [r for r in ranges if "/" not in r]
    return F.coalesce((hit | c.isin(single)) if single else hit, F.lit(False))


def is_public(c: Column) -> Column:
    """Valid and outside the private and reserved ranges. Documentation blocks count as public."""
    closed = PRIVATE_RANGES + RESERVED_RANGES
    low = c.rlike(rf"\A(?!{_ipv4_ranges(closed)}){_DOTTED}\z")
    high = ~ipv6_digits(c).rlike(_ipv6_ranges(closed))
    return F.coalesce(F.when(_has_colon(c), high).otherwise(low), F.lit(False))


def is_blocked(c: Column) -> Column:
    return ~is_public(c) | in_any_cidr(c, BLOCKED_RANGES)


def _listed(c: Column) -> Column:
    return F.transform(F.split(c, ","), lambda x: trimmed(x))


def _first(items: Column, test) -> Column:
    return F.get(F.filter(items, test), F.lit(0))


def client_ip(
    variant: str,
    cf: Column,
    true_client: Column,
    real: Column,
    forwarded: Column,
    remote: Column,
    trusted_proxies: Sequence[str] = (),
    trust_headers: bool = False,
    trust_cf: bool = False,
    cf_country: Column | None = None,
    cf_ray: Column | None = None,
) -> Column:
    """Client address out of proxy headers, ``0.0.0.0`` when none is usable.

    ``detector`` reads headers only when they are trusted and takes the first public, else first valid entry of a
    list. ``client`` accepts a list in the forwarded header only, and only public entries of it. ``secure`` ignores
    the enterprise header and takes the first entry of any list.
    """
    chain = [cf, true_client, real, forwarded, remote]
    if variant == "secure":
        firsts = [trimmed(F.get(F.split(c, ","), F.lit(0))) for c in (cf, real, forwarded, remote)]
        return F.coalesce(*[F.when(is_ip(c), c) for c in firsts], F.lit(NO_ADDRESS))
    if variant == "client":
        found = []
        for c in chain:
            whole = F.when(is_ip(trimmed(c)), trimmed(c))
            if c is forwarded:
                whole = F.when(c.contains(","), _first(_listed(c), is_public)).otherwise(whole)
            found.append(whole)
        return F.coalesce(*found, F.lit(NO_ADDRESS))
    if variant == "detector":
        def pick(c: Column) -> Column:
            entries = _listed(c)
            return F.coalesce(_first(entries, is_public), _first(entries, is_ip))

        trusted = F.lit(trust_headers)
        if trust_cf:
            marks = [c for c in (cf, cf_country, cf_ray) if c is not None]
            for c in marks:
                trusted = trusted | F.coalesce(~c.isin("", "0"), F.lit(False))
        if trusted_proxies:
            trusted = trusted | in_any_cidr(F.coalesce(remote, F.lit(NO_ADDRESS)), trusted_proxies)
        headers = F.coalesce(*[pick(c) for c in chain[:-1]])
        return F.coalesce(F.when(trusted, headers), pick(remote), F.lit(NO_ADDRESS))
    raise ValueError(f"unknown variant: {variant}")


def _edge(digits: Column, length: Column, last: bool) -> Column:
    """First or last address, as digits, of the block that the first ``length`` bits name."""
    whole, rest = F.floor(length / 4).cast("int"), (length % 4).cast("int")
    size = F.pow(F.lit(2), F.lit(4) - rest).cast("int")
    digit = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    cut = digit - digit % size + (size - 1 if last else 0)
    head = F.concat(F.substring(digits, F.lit(1), whole), F.when(rest > 0, F.lower(F.hex(cut))).otherwise(""))
    return F.rpad(head, F.length(digits), "f" if last else "0")


def match_cidr_table(df: DataFrame, ip: str, ranges: DataFrame, cidr: str = "cidr") -> DataFrame:
    """Rows of ``df`` whose address lies in a *table* of ranges, for lists too long to write out.

    Ranges become intervals of hexadecimal digits and distinct addresses points of one sweep over both, so neither a
    short prefix nor a list of any length multiplies rows, and no range join is needed. A frequent address is one point.
    """
    address, length = F.split_part(F.col(cidr), F.lit("/"), F.lit(1)), F.split_part(F.col(cidr), F.lit("/"), F.lit(2))

    def with_digits(frame: DataFrame, c: Column, *others: Column) -> DataFrame:
        found = F.when(_has_colon(c), ipv6_digits(c)).otherwise(ipv4_digits(c))
        frame = frame.select(*others, computed_once(found).alias("_digits"))
        return frame.where("_digits is not null").withColumn("_width", F.length("_digits"))

    listed = with_digits(ranges, address, length.try_cast("int").alias("_given"))
    listed = listed.withColumn("_length", F.coalesce("_given", F.col("_width") * 4)).where("_length between 0 and _width * 4")
    size = F.col("_length")
    blocks = listed.select("_width", _edge(F.col("_digits"), size, False).alias("_low"),
                           _edge(F.col("_digits"), size, True).alias("_high"))
    addresses = staged(with_digits(df.select(F.col(ip).alias("_ip")).distinct(), F.col("_ip"), F.col("_ip")), "addresses")
    inside = covered_points(addresses.select("_width", "_digits").distinct(), blocks, "_width", "_digits", "_low", "_high")
    hits = addresses.join(inside, ["_width", "_digits"], "left_semi").select(F.col("_ip").alias(ip), F.lit(True).alias("_in"))
    return lookup_join(df, hits, ip).where("_in").select(*df.columns)
