"""Network class of an address, from the special-purpose registries."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# Special-purpose address blocks (IANA registries).
PRIVATE_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
)
PRIVATE_V4_EXCEPT = ("192.0.0.9/32", "192.0.0.10/32")
SHARED_V4 = ("100.64.0.0/10",)
PRIVATE_V6 = (
    "::1/128", "::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32",
    "2002::/16", "fc00::/7", "fe80::/10",
)
PRIVATE_V6_EXCEPT = (
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28",
)

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_HEXTET = r"[0-9a-f]{1,4}"


def _v4_text_pattern(block: str) -> str:
    """Dotted text of every address in ``block``."""
    net = ipaddress.ip_network(block)
    octets = []
    for low, high in zip(net[0].packed, net[-1].packed):
        if (low, high) == (0, 255):
            octets.append(_OCTET)
        else:
            octets.append("(?:" + "|".join(str(n) for n in range(low, high + 1)) + ")")
    return r"\.".join(octets)


def _hex_pattern(block: str) -> str:
    """Hex digits of every address in ``block``, without the free digits at the end."""
    net = ipaddress.ip_network(block)
    low, high = net[0].packed.hex(), net[-1].packed.hex()
    digits = []
    for a, b in zip(low, high):
        if (a, b) == ("0", "f"):
            break
        digits.append("[" + "".join(f"{n:x}" for n in range(int(a, 16), int(b, 16) + 1)) + "]")
    return "".join(digits)


def _choice(blocks: tuple[str, ...], pattern) -> str:
    return "(?:" + "|".join(pattern(b) for b in blocks) + ")"


_MAPPED = "0{20}ffff"
_PRIVATE = f"(?!{_choice(PRIVATE_V4_EXCEPT, _v4_text_pattern)}\\z){_choice(PRIVATE_V4, _v4_text_pattern)}\\z"
_PRIVATE_TEXT = rf"\A{_PRIVATE}"
_PUBLIC_TEXT = rf"\A(?!{_PRIVATE}|{_choice(SHARED_V4, _v4_text_pattern)}\z){_V4}\z"
_PRIVATE_HEX = (
    rf"\A(?:{_MAPPED}(?!{_choice(PRIVATE_V4_EXCEPT, _hex_pattern)}){_choice(PRIVATE_V4, _hex_pattern)}"
    rf"|(?!{_MAPPED})(?!{_choice(PRIVATE_V6_EXCEPT, _hex_pattern)}){_choice(PRIVATE_V6, _hex_pattern)})"
)


def _octets(text: Column) -> list[Column]:
    return [F.split_part(text, F.lit("."), F.lit(i)).try_cast("bigint") for i in (1, 2, 3, 4)]


def ipv4_to_long(ip: Column) -> Column:
    """Dotted quad as a number; null for anything else, also leading zeros."""
    a, b, c, d = _octets(ip)
    return F.when(ip.rlike(rf"\A{_V4}\z"), a * 16777216 + b * 65536 + c * 256 + d)


# Eight hextets, or fewer around one gap.
_SIDE = rf"(?:{_HEXTET}(?::{_HEXTET})*)?"
_V6 = rf"\A(?:{_HEXTET}(?::{_HEXTET}){{7}}|(?!:*(?:[0-9a-f]+:+){{7}}[0-9a-f]){_SIDE}::{_SIDE})\z"


def ipv6_to_hex(ip: Column) -> Column:
    """The address as 32 lower-case hex digits; null if it is malformed."""
    text = F.regexp_replace(F.lower(ip), r"%[^%/]+\z", "")
    # A dotted tail stands for the last two hextets.
    tail = F.regexp_extract(text, rf":({_V4})\z", 1)
    tail_hex = F.concat(*[F.lpad(F.lower(F.hex(o)), 2, "0") for o in _octets(tail)])
    dotted = F.concat(F.regexp_replace(text, r"[^:]*\z", ""), F.regexp_replace(tail_hex, r"(.{4})\z", ":$1"))
    text = F.when(text.rlike(rf":{_V4}\z"), dotted).otherwise(text)
    # The gap becomes as many zero hextets as are missing from eight.
    zeros = F.repeat(F.lit("0:"), F.lit(8) - F.regexp_count(text, F.lit("[0-9a-f]+")))
    digits = F.replace(text, F.lit("::"), F.concat(F.lit(":"), zeros))
    for width in (1, 2, 3):
        digits = F.regexp_replace(digits, rf"\b([0-9a-f]{{{width}}})\b", "0" * (4 - width) + "$1")
    return F.when(text.rlike(_V6), F.replace(digits, F.lit(":"), F.lit("")))


def is_valid_ip(ip: Column) -> Column:
    valid = ip.rlike(rf"\A{_V4}\z") | (ip.contains(":") & ipv6_to_hex(ip).isNotNull())
    return F.coalesce(valid, F.lit(False))


def is_internal_ip(ip: Column) -> Column:
    """True for special-purpose addresses; false for public and invalid ones."""
    internal = ip.rlike(_PRIVATE_TEXT) | (ip.contains(":") & ipv6_to_hex(ip).rlike(_PRIVATE_HEX))
    return F.coalesce(internal, F.lit(False))


def is_global_ip(ip: Column) -> Column:
    """True for public addresses; IPv4 shared carrier space is neither class."""
    public = ip.rlike(_PUBLIC_TEXT) | (ip.contains(":") & ~ipv6_to_hex(ip).rlike(_PRIVATE_HEX))
    return F.coalesce(public, F.lit(False))


def ip_class(ip: Column) -> Column:
    return F.when(is_internal_ip(ip), "Internal").otherwise("External")
