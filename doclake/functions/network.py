"""URL and address columns: admissible schemes, host names, public-address test."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Address blocks that are private, loopback, link-local, multicast, reserved or
# unspecified, as (first, last) in hexadecimal: 8 digits for IPv4, 32 for IPv6.
BLOCKED_V4 = (
    ("00000000", "00ffffff"),  # 0.0.0.0/8
    ("0a000000", "0affffff"),  # 10.0.0.0/8
    ("7f000000", "7fffffff"),  # 127.0.0.0/8
    ("a9fe0000", "a9feffff"),  # 169.254.0.0/16
    ("ac100000", "ac1fffff"),  # 172.16.0.0/12
    ("c0000000", "c0000008"),  # 192.0.0.0/24 but for .9 and .10
    ("c000000b", "c00000ff"),
    ("c0000200", "c00002ff"),  # 192.0.2.0/24
    ("c0a80000", "c0a8ffff"),  # 192.168.0.0/16
    ("c6120000", "c613ffff"),  # 198.18.0.0/15
    ("c6336400", "c63364ff"),  # 198.51.100.0/24
    ("cb007100", "cb0071ff"),  # 203.0.113.0/24
    ("e0000000", "efffffff"),  # 224.0.0.0/4
    ("f0000000", "ffffffff"),  # 240.0.0.0/4
)
BLOCKED_V6 = (
    ("0" * 32, "1fff" + "f" * 28),  # everything below 2000::/3
    ("2001" + "0" * 28, "20010001" + "0" * 24),  # 2001::/23 but for the global blocks inside it
    ("20010001" + "0" * 23 + "3", "20010002" + "f" * 24),
    ("20010004" + "0" * 24, "200100040111" + "f" * 20),
    ("200100040113" + "0" * 20, "2001001f" + "f" * 24),
    ("20010040" + "0" * 24, "200101ff" + "f" * 24),
    ("20010db8" + "0" * 24, "20010db8" + "f" * 24),  # 2001:db8::/32
    ("2002" + "0" * 28, "2002" + "f" * 28),  # 2002::/16
    ("4000" + "0" * 28, "febf" + "f" * 28),  # everything above 2000::/3 up to fec0::/10
    ("ff00" + "0" * 28, "f" * 32),  # ff00::/8
)

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
_GROUP = "[0-9a-f]{1,4}"


# Scheme, authority and path; whatever characters the last two hold.
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"


def _part(url: Column, group: int) -> Column:
    """A part of ``url`` after leading blanks and control characters, line breaks and tabs are dropped."""
    clean = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    return F.regexp_extract(clean, _URL, group)


def url_host(url: Column) -> Column:
    """Lower-case host of ``url`` without user, port and the brackets of an IPv6 literal; null if there is
    none or its brackets do not match."""
    place = F.substring_index(_part(url, 2), "@", -1)
    literal = F.regexp_extract(place, r"^\[([^\[\]]*)\](?::[^\[\]]*)?$", 1)
    host = F.when(F.contains(place, F.lit("[")) | F.contains(place, F.lit("]")), literal)
    return F.nullif(F.lower(host.otherwise(F.substring_index(place, ":", 1))), F.lit(""))


def url_admissible(url: Column) -> Column:
    """``http`` or ``https`` with a host; anything that does not parse is refused."""
    return F.coalesce(
        url.startswith("http") & F.lower(_part(url, 1)).isin("http", "https") & url_host(url).isNotNull(), F.lit(False)
    )


def url_basename(url: Column) -> Column:
    """Last path segment as a file-name hint; null when the path ends in a slash."""
    return F.nullif(
        F.regexp_extract(_part(url, 3), "[^/]*$", 0), F.lit("")
    )


def _hex_v4(ip: Column) -> Column:
    octets = F.transform(F.split(ip, r"\."), lambda o: F.lpad(F.hex(o.cast("int")), 2, "0"))
    return F.lower(F.array_join(octets, ""))


def _hex_groups(part: Column) -> Column:
    groups = F.filter(F.split(part, ":"), lambda g: g != "")
    return F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` mentions it."""
    return F.transform(F.array(value), body)[0]


def _dotted_tail_as_groups(text: Column) -> Column:
    """``::ffff:1.2.3.4`` as ``::ffff:0102:0304``; other texts as they are."""

    def swap(tail: Column) -> Column:
        digits = _hex_v4(tail)
        head = F.regexp_replace(text, rf"{_V4}$", "")
        return F.when(tail == "", text).otherwise(
            F.concat(head, F.substring(digits, 1, 4), F.lit(":"), F.substring(digits, 5, 4))
        )

    return _let(F.regexp_extract(text, rf"(?<=:)({_V4})$", 1), swap)


def _hex_v6(text: Column) -> Column:
    full = text.rlike(rf"^{_GROUP}(?::{_GROUP}){{7}}$")
    short = text.rlike(rf"^(?:{_GROUP}(?::{_GROUP})*)?::(?:{_GROUP}(?::{_GROUP})*)?$")
    sides = F.array(
        _hex_groups(F.substring_index(text, "::", 1)), _hex_groups(F.substring_index(text, "::", -1))
    )

    def fill(pair: Column) -> Column:
        gap = F.lit(32) - F.length(pair[0]) - F.length(pair[1])
        return F.when(gap >= 4, F.concat(pair[0], F.repeat(F.lit("0"), gap), pair[1]))

    return F.when(full, _hex_groups(text)).when(short, _let(sides, fill))


def ip_hex(ip: Column) -> Column:
    """Address literal as fixed-width hex (8 digits for IPv4, 32 for IPv6); null if it is neither."""
    text = F.lower(F.regexp_replace(ip, "%.*$", ""))
    return F.when(ip.rlike(rf"^{_V4}$"), _hex_v4(ip)).when(
        F.contains(ip, F.lit(":")), _let(_let(text, _dotted_tail_as_groups), _hex_v6)
    )


def _blocked(value: Column, ranges) -> Column:
    table = F.expr("array(" + ", ".join(f"struct('{low}' AS low, '{high}' AS high)" for low, high in ranges) + ")")
    return F.exists(table, lambda r: value.between(r["low"], r["high"]))


def is_public_ip(ip: Column) -> Column:
    """True for a globally reachable literal, false for a blocked one, null if not an address.

    The range join against the blocked blocks is a constant predicate: the table is a handful of
    rows, so it folds into the projection and needs neither a broadcast nor a shuffle.
    """

    def public(value: Column) -> Column:
        narrow = F.length(value) == 8
        blocked = F.when(narrow, _blocked(value, BLOCKED_V4)).otherwise(_blocked(value, BLOCKED_V6))
        return F.when(value.isNotNull(), ~blocked)

    return _let(ip_hex(ip), public)
