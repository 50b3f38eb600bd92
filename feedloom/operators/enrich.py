"""Lookup enrichment joins.

Joins carry no hint: the planner and AQE broadcast a lookup table when its measured
bytes are small.  The IP lookup is a range join turned into an equi-join on address
prefixes, so its work does not depend on how ranges crowd together.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from feedloom.functions import zfill5
from feedloom.functions.net import address_bits, range_prefixes


def enrich_technology(df: DataFrame, dim: DataFrame, key: str = "modelo") -> DataFrame:
    """Left join model -> technology.  Duplicate dim keys multiply rows; null keys never match."""
    return df.join(dim, key, "left")


def enrich_income(df: DataFrame, dim: DataFrame, key: str = "ip_postal_code",
                  dim_key: str = "codigo_postal") -> DataFrame:
    """Left join postal code -> mean income; the zero-pad is applied to the dimension only."""
    d = dim.withColumn(dim_key, zfill5(dim_key)).withColumnRenamed(dim_key, key)
    return df.join(d, key, "left")


# Output columns of the IP enrichment, in order (fixed schema).
IP_COLUMNS = ["ip_country_name", "ip_region", "ip_city", "ip_postal_code", "ip_latitude", "ip_longitude"]
_RANGE_ATTRS = {
    "country_name": "ip_country_name",
    "region": "ip_region",
    "city": "ip_city",
    "postal_code": "ip_postal_code",
    "latitude": "ip_latitude",
    "longitude": "ip_longitude",
}
_SALTS = 4096


@F.pandas_udf(StringType())
def _bits(texts: pd.Series) -> pd.Series:
    return texts.map(address_bits, na_action="ignore")


_BYTE = "(0|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_IPV4 = rf"\A{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}\z"


def with_bits(ips: DataFrame, ip_col: str) -> DataFrame:
    """(ip, bits) of the addresses among ``ips``: IPv4 by column functions, the rest (with colons) by Python."""
    ip = F.col(ip_col)
    numbers = F.split(ip, r"\.")
    v4 = F.concat(F.lit("4"), *[F.lpad(F.bin(numbers[i].cast("bigint")), 8, "0") for i in range(4)])
    plain = ips.where(ip.rlike(_IPV4)).select(ip.alias("ip"), v4.alias("bits"))
    long = ips.where(ip.contains(":")).select(ip.alias("ip"), _bits(ip_col).alias("bits")).where(F.col("bits").isNotNull())
    return plain.unionByName(long)


def _prefixes(ranges: DataFrame) -> DataFrame:
    """Each [ip_lo, ip_hi] range as the address prefixes that make it up (at most two per bit of an address).

    Bounds are addresses as text or, for IPv4, as numbers.
    """
    cols = [c for c in ranges.columns if c not in ("ip_lo", "ip_hi")]
    packed = ranges.select(F.col("ip_lo").cast("string").alias("lo"), F.col("ip_hi").cast("string").alias("hi"), F.struct(F.lit(0).alias("_"), *cols).alias("attrs"))

    @F.pandas_udf(ArrayType(StringType()))
    def cover(lo: pd.Series, hi: pd.Series) -> pd.Series:
        return pd.Series([range_prefixes(a, b) for a, b in zip(lo, hi)], dtype=object)

    return packed.select(F.explode(cover("lo", "hi")).alias("prefix"), "attrs")


def _matches(addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """(ip, attrs) of the most specific range of each address; ``addresses`` has ip and bits."""
    covered = _prefixes(ranges).checkpoint()  # used for the lengths and for the join
    # the prefix lengths that occur, one row for each address family: at most 33 and 129 numbers
    family = F.substring("prefix", 1, 1).alias("family")
    lengths = F.broadcast(covered.groupBy(family).agg(F.collect_set(F.length("prefix")).alias("lengths")))
    known = addresses.withColumn("family", F.substring("bits", 1, 1)).join(lengths, "family")
    probes = known.select("ip", F.explode(F.expr("transform(lengths, n -> substring(bits, 1, n))")).alias("prefix"))
    return probes.join(covered, "prefix").groupBy("ip").agg(F.max_by("attrs", F.length("prefix")).alias("attrs"))


def ip_lookup(ips: DataFrame, city: DataFrame, asn: DataFrame, ip_col: str = "ip") -> DataFrame:
    """Distinct IP text -> location attributes; an IP must hit *both* databases."""
    addresses = with_bits(ips, ip_col)
    located = _matches(addresses, city)
    owned = _matches(addresses, asn.select("ip_lo", "ip_hi")).select("ip")
    cols = [F.col(f"attrs.{src}").alias(dst) if src in city.columns else F.lit(None).alias(dst)
            for src, dst in _RANGE_ATTRS.items()]
    return located.join(owned, "ip", "left_semi").select(F.col("ip").alias(ip_col), *cols)


def _spread_nulls(key: Column) -> Column:
    """The key, or one of many texts that no address equals, so that null keys do not meet in one task."""
    return F.coalesce(key, F.concat(F.lit("-"), F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS)).cast("string")))


def enrich_ip(df: DataFrame, city: DataFrame, asn: DataFrame, ip_col: str = "ip") -> DataFrame:
    """Add the fixed six IP attribute columns; any miss (either DB, malformed, null) -> all null.

    IPv4 and IPv6.  Only distinct non-null IPs are looked up (map-side combined), then
    the attributes are left-joined back on the IP text; AQE splits a hot IP's partition
    on the fact side if one address dominates.
    """
    ips = df.where(F.col(ip_col).isNotNull()).select(ip_col).distinct()
    geo = ip_lookup(ips, city, asn, ip_col).withColumnRenamed(ip_col, "_ip")
    keyed = df.withColumn("_key", _spread_nulls(F.col(ip_col)))
    return keyed.join(geo, F.col("_key") == F.col("_ip"), "left").drop("_key", "_ip")
