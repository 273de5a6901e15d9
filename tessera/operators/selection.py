"""Exact order statistics of groups, without sorting and without a group in one task.

A value becomes an order-preserving 64-bit whole number. Its first 16 bits are counted by group
(counts are summed before any shuffle, so a frequent group or value is a few rows); the
bucket that holds a wanted rank is known from these sums, and only rows of such buckets
are counted by their next 16 bits, until all 64 are known. Groups may be few with many rows
or many with few: the wanted buckets are broadcast up to MOST_WANTED, beyond that they are
joined by shuffle in SALTS parts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.sources import tables

STEP = 16
MOST_WANTED, SALTS = 100_000, 32


def ordered_bits(value: Column) -> Column:
    """A double as a whole number that sorts as it does: NaN last, -0.0 as 0.0."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.when(value == 0, F.lit(0.0)).otherwise(value)).cast("long")
    return F.when(value.isNotNull(), F.when(bits < 0, F.bitwise_not(bits).bitwiseXOR(F.lit(-(1 << 63)))).otherwise(bits))


def from_ordered_bits(bits: Column) -> Column:
    back = F.when(bits < 0, F.bitwise_not(bits.bitwiseXOR(F.lit(-(1 << 63))))).otherwise(bits)
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), back).cast("double")


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)), F.lit(True))


def _located(counts: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """by, name, prefix (the bucket that holds the target's rank), rank (within that bucket); counts: by, [within], bucket, n; targets: by, name, [prefix], rank."""
    inside = ["within"] if "within" in counts.columns else []
    upto = F.sum("n").over(W.partitionBy(*by, *inside).orderBy("bucket"))  # at most 65,536 rows
    c = counts.select(*(F.col(x).alias(f"c_{x}") for x in by), *inside, "bucket", "n", upto.alias("upto"))
    on = _same(by, [f"c_{x}" for x in by]) & (F.col("prefix") == F.col("within") if inside else F.lit(True))
    hit = (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n"))
    return targets.join(c, on & hit).select(*by, "name", F.col("bucket").alias("prefix"), (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))


def select_ranks(rows: DataFrame, by: list[str], key: Column, ranks: dict[str, Callable[[Column], Column]], most_wanted: int = MOST_WANTED) -> DataFrame:
    """by, name, key: for each group and name the ``ranks[name](n)``-th smallest (from 1) of the group's n keys (long; nulls do not count).

    Groups without a key have no row. Null groups are a group.
    """
    rows = rows.select(*by, key.alias("_key")).where("_key is not null")
    counts = tables.written(rows.groupBy(*by, F.shiftright("_key", 64 - STEP).alias("bucket")).agg(F.count(F.lit(1)).alias("n")), "counts")
    n = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), f(F.col("total")).cast("long").alias("rank")) for k, f in ranks.items())))
    targets = n.select(*by, each.alias("t")).select(*by, "t.name", "t.rank")
    found = tables.written(_located(counts, targets, by), "ranks")
    few = found.count() <= most_wanted  # as many as groups times names, at every step
    for known in range(STEP, 64, STEP):
        wanted = found.select(*(F.col(x).alias(f"w_{x}") for x in by), F.col("prefix").alias("w_prefix")).distinct()
        on = _same(by, [f"w_{x}" for x in by]) & (F.shiftright("_key", 64 - known) == F.col("w_prefix"))
        if few:
            rest = rows.join(F.broadcast(wanted), on, "left_semi")
        else:
            parts = wanted.withColumn("w_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            salted = rows.withColumn("_salt", F.floor(F.rand(known) * SALTS).cast("int"))
            rows = rest = tables.written(salted.join(parts, on & (F.col("_salt") == F.col("w_salt")), "left_semi").drop("_salt"), "rest")
        counts = rest.groupBy(*by, F.shiftright("_key", 64 - known).alias("within"), F.shiftright("_key", 64 - known - STEP).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
        found = tables.written(_located(counts, found, by), "ranks")
    return found.select(*by, "name", F.col("prefix").alias("key"))


def nearest_ranks(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by, min, max, median (the midpoint of the middle two) and, for each of ``shares``, the value at rank ceil(share * n); doubles. Null values do not count; groups without a value have no row."""
    names = {"min": lambda n: F.lit(1), "max": lambda n: n, "_low": lambda n: F.ceil(n / 2), "_high": lambda n: F.floor(n / 2) + 1}
    names |= {k: (lambda n, s=s: F.greatest(F.ceil(F.round(F.lit(s) * n, 9)), F.lit(1))) for k, s in shares.items()}
    found = select_ranks(rows, by, ordered_bits(F.col(value).cast("double")), names)
    at = {k: F.max(F.when(F.col("name") == k, F.col("key"))) for k in names}
    wide = found.groupBy(*by).agg(*(v.alias(k) for k, v in at.items()))
    out = wide.select(*by, *(from_ordered_bits(F.col(k)).alias(k) for k in names))
    return out.select(*by, "min", ((F.col("_low") + F.col("_high")) / 2).alias("median"), *shares, "max")
