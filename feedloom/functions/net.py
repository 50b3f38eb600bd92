"""Network addresses as bit texts: ``4`` or ``6`` and the address's bits, so that a range is a set of prefixes."""

from __future__ import annotations

import ipaddress


def _bits(address: ipaddress.IPv4Address | ipaddress.IPv6Address, length: int) -> str:
    return f"{address.version}{int(address):0{address.max_prefixlen}b}"[: 1 + length]


def address_bits(text: str) -> str | None:
    """Bits of an address; null where the text is not one (blanks around it and leading zeros are not allowed)."""
    try:
        address = ipaddress.ip_address(text)
    except ValueError:
        return None
    return _bits(address, address.max_prefixlen)


def range_prefixes(low: str | None, high: str | None) -> list[str]:
    """Prefixes of the range between two addresses, both included; plain numbers are IPv4."""
    if low is None or high is None:
        return []
    a, b = (ipaddress.IPv4Address(int(x)) if x.isdigit() else ipaddress.ip_address(x) for x in (low, high))
    return [_bits(n.network_address, n.prefixlen) for n in ipaddress.summarize_address_range(a, b)]
