"""Addresses against a table of ranges (F3), as a join on prefixes.

An address is a text of bits behind its family ('4' or '6'); a range of n bits is the first n of them. An address lies
in a range if its own first n bits are the range's, so the join needs no comparison of bounds: each address looks up
one prefix for every length that occurs in the table (at most 162, commonly a handful), by equality. The table of ranges
may be any table with a ``cidr`` column, of any size.

As in the scanner, an address belongs to ranges of its own family only; with ``mapped`` an IPv4 address that is written
as IPv6 (``::ffff:10.0.0.1``) is looked up as IPv4 too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exposa.functions import fixed
from exposa.functions.scope import IPV4

# Hex digits and colons, a dotted IPv4 address at the end if any.
_V6 = r"^[0-9a-f:]*:(?:[0-9a-f]{0,4}|" + IPV4[1:-1] + ")$"


def _v4(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, r"\."), lambda o: F.lpad(F.conv(o, 10, 2), 8, "0")), "")


def _hextets(text: Column) -> Column:
    parts = F.filter(F.split(text, ":", -1), lambda h: h != "")
    return F.array_join(F.transform(parts, lambda h: F.when(h.contains("."), _v4(h)).otherwise(F.lpad(F.conv(h, 16, 2), 16, "0"))), "")


def bits(host: Column) -> Column:
    """'4' and 32 bits, or '6' and 128 bits, of an address in text; null for anything else."""
    h = F.lower(host)
    gap = h.contains("::")
    left = _hextets(F.substring_index(h, "::", 1))
    right = F.when(gap, _hextets(F.substring_index(h, "::", -1))).otherwise(F.lit(""))
    room = 128 - F.length(left) - F.length(right)
    v6 = F.concat(F.lit("6"), left, F.repeat(F.lit("0"), room), right)
    # one gap at most, which stands for something; no single colon at an end
    well = ~h.rlike(r"::.*::|:::|^:[^:]|[^:]:$|[0-9a-f]{5}") & F.when(gap, room >= 16).otherwise(room == 0)
    return F.when(h.rlike(IPV4), F.concat(F.lit("4"), _v4(h))).when(h.rlike(_V6) & F.coalesce(well, F.lit(False)), v6)


def ranges(spark: SparkSession, cidrs: list[str] = fixed.PRIVATE_RANGES) -> DataFrame:
    return spark.createDataFrame([(c,) for c in cidrs], "cidr string")


def prefixes(table: DataFrame) -> DataFrame:
    """(cidr, length, prefix) of a table's ranges; a text that is no range is dropped, a bare address is one of its own."""
    b = bits(F.substring_index("cidr", "/", 1))
    full = F.length(b) - 1
    n = F.when(F.col("cidr").contains("/"), F.substring_index("cidr", "/", -1).try_cast("int")).otherwise(full)
    return (table.select("cidr", b.alias("b"), n.alias("n"), full.alias("full")).where("n BETWEEN 0 AND full")
            .select("cidr", (F.col("n") + 1).alias("length"), F.expr("substring(b, 1, n + 1)").alias("prefix")).distinct())


def in_ranges(df: DataFrame, host: str, table: DataFrame, mapped: bool = False) -> DataFrame:
    """The rows of ``df`` with a ``cidr`` for each range that their address lies in; other rows are not returned."""
    known = prefixes(table)
    lengths = [r[0] for r in known.select("length").distinct().collect()]  # at most 33 + 129
    own = F.col("_bits")
    v4 = F.when(own.startswith("6" + "0" * 80 + "1" * 16), F.concat(F.lit("4"), F.substring(own, 98, 32)))
    ways = F.filter(F.array(own, v4 if mapped else F.lit(None).cast("string")), lambda b: b.isNotNull())
    rows = df.withColumn("_bits", bits(F.col(host))).where("_bits IS NOT NULL").withColumn("_bits", F.explode(ways))
    lookups = F.array(*[F.struct(F.lit(n).alias("length"), F.substring(own, 1, n).alias("prefix")) for n in lengths])
    lookups = lookups.cast("array<struct<length:int,prefix:string>>")  # also without ranges
    rows = rows.withColumn("_l", F.explode(F.filter(lookups, lambda l: F.length(l["prefix"]) == l["length"])))
    rows = rows.select(*df.columns, F.col("_l.length").alias("length"), F.col("_l.prefix").alias("prefix"))
    return rows.join(known, ["length", "prefix"]).select(*df.columns, known["cidr"])
