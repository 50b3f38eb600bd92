"""IP lookup: crowded ranges, IPv6, malformed addresses, nulls."""

import ipaddress
import random

from pyspark.sql import functions as F

from feedloom.functions.net import address_bits, range_prefixes
from feedloom.operators import enrich as J

RANGES = "ip_lo string, ip_hi string, country_name string, city string"


def test_prefixes_cover_exactly_the_range():
    rng = random.Random(1)
    for _ in range(300):
        a, b = sorted(rng.randrange(2**12) + 10 * 2**24 for _ in range(2))
        prefixes = range_prefixes(str(a), str(b))
        for x in {a - 1, a, (a + b) // 2, b, b + 1}:
            bits = address_bits(str(ipaddress.IPv4Address(x)))
            assert any(bits.startswith(p) for p in prefixes) == (a <= x <= b)
    assert address_bits("08.8.8.8") is None and address_bits(" 8.8.8.8") is None and address_bits("8.8.8") is None
    assert address_bits("::1") == "6" + "0" * 127 + "1"


def test_enrich_ip_crowded_ranges_and_ipv6(spark):
    """Hundreds of ranges inside one /16, a wider one round some, IPv6, and what is not an address."""
    rows = [(f"10.1.{k}.{4 * j}", f"10.1.{k}.{4 * j + 2}", "X", f"c{k}-{j}") for k in range(40) for j in range(20)]
    rows += [("10.1.100.0", "10.1.200.255", "X", "wide"), ("10.1.150.0", "10.1.150.255", "X", "narrow")]
    rows += [("2001:db8::", "2001:db8::ffff", "Y", "six"), ("1", "3", "Z", "low")]
    city = spark.createDataFrame(rows, RANGES)
    asn = spark.createDataFrame([("10.1.0.0", "10.1.255.255"), ("2001:db8::", "2001:db8:ffff::"), ("0", "2")], "ip_lo string, ip_hi string")
    ips = [f"10.1.{k}.{x}" for k in (0, 7, 39, 40, 99) for x in range(0, 90)] + ["10.1.150.9", "10.1.149.9", "10.1.201.0", "2001:db8::abc", "2001:DB8:0::ABC", "2001:db8:1::", "0.0.0.1", "0.0.0.3", "010.1.0.1", " 10.1.0.1", "bad", "", None, None, None]
    df = spark.createDataFrame([(k, ip) for k, ip in enumerate(ips)], "id int, ip string")

    def expected(ip):
        try:
            x = ipaddress.ip_address(ip)
        except ValueError:
            return None
        same = lambda s: ipaddress.IPv4Address(int(s)) if s.isdigit() else ipaddress.ip_address(s)
        inside = lambda lo, hi: same(lo).version == x.version and same(lo) <= x <= same(hi)
        hits = [(int(same(r[1])) - int(same(r[0])), r[3]) for r in rows if inside(r[0], r[1])]
        owned = any(inside(r.ip_lo, r.ip_hi) for r in asn.collect())
        return min(hits)[1] if hits and owned else None

    out = J.enrich_ip(df, city, asn)
    assert out.columns == ["id", "ip", *J.IP_COLUMNS] and out.count() == len(ips)
    known = {ip: expected(ip) for ip in ips if ip is not None}
    for r in out.collect():
        assert r.ip_city == (known[r.ip] if r.ip is not None else None), r
    assert out.where(F.col("ip_city").isNotNull()).count() > 150
