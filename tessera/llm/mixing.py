"""Mixing sources to target weights by hash-threshold histograms.

Words are summed by source and hash bucket, the bucket in which a source's budget ends
is found from running sums, and only that bucket is refined, digit by digit of the
hash, until single documents remain. Documents are never sorted and no source is ever
gathered: a level needs one partial aggregation and a window of at most ``BUCKETS`` rows
per source. All of it is DataFrame functions.

Water-filling of the targets works on one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize, release

WORD = r"[^\x20\x09-\x0D]+"
BITS, LEVELS = 12, 5
BUCKETS = 1 << BITS


def order_hash(key: Column) -> Column:
    """60 bits of a key's md5; the order in which a source's documents are taken."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """Targets of sources by capped proportional sharing.

    sizes: one row per source (source, source_size). Sources in code-point order, null
    last, get the weights in turn. Shares add up to all sizes; no target exceeds
    ``max_repeat`` times its source, and what is over is shared anew by weight. With
    sources ordered by cap / weight, the level at which sharing settles is the first
    ``(total - caps before) / weights from here`` that the source's own cap reaches.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights) + 1
    ranked = sizes.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), turn).cast("long").alias("weight"))
    ranked = ranked.withColumn("cap", max_repeat * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    fill = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    levels = ranked.select(
        "*",
        ((F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))).alias("level"),
        F.row_number().over(fill).alias("place"),
    )
    settled = F.min_by("level", F.when(F.col("ratio") >= F.col("level"), F.col("place"))).over(everything)
    return levels.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * settled).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source", with_rows: bool = False) -> DataFrame:
    """How many words of each document a mix with the given source weights takes.

    Returns one row per row of ``docs``: doc_id, size (words; null text: 0), source_size,
    target and taken (size times the number of times the document is used). Each document
    is used floor(target / source_size) times; the rest of the target goes to the documents
    below the source's hash threshold, and the document at the threshold is added if that
    brings the sum nearer. Rows with the same doc_id share a hash and are used alike. An
    empty table gives no rows; a source without words has target 0. Other columns of
    ``docs`` are not read; ``with_rows`` returns the whole row in addition, as struct ``row``.
    """
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), order_hash(F.col(doc_id)).alias("h"), F.struct(*docs.columns).alias("row"))
    base = materialize(keyed.drop("row"), "mix-sizes")
    targets = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat)
    whole = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long")
    edge = targets.select("source", "source_size", "target", whole.alias("whole"), F.floor(F.col("target") - whole * F.col("source_size")).cast("long").alias("rest"), F.lit(0).cast("long").alias("prefix"))
    edge = materialize(edge, "mix-targets")
    for level in range(1, LEVELS + 1):
        edge = _refine(base, edge, level)
    rows = (keyed if with_rows else base).withColumnRenamed("source", "of")
    used = F.col("whole") + F.when((F.col("h") < F.col("prefix")) | ((F.col("h") == F.col("prefix")) & F.col("take_edge")), 1).otherwise(0)
    out = rows.join(edge, F.col("of").eqNullSafe(F.col("source")), "left")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * used).alias("taken"), *["row"] * with_rows)


def _refine(base: DataFrame, edge: DataFrame, level: int) -> DataFrame:
    """One more digit of each source's threshold: sums by bucket within the boundary bucket of the level above."""
    shift = BITS * (LEVELS - level)
    up = F.shiftright("h", shift + BITS) if level > 1 else F.lit(0).cast("long")
    rows = base.where("size > 0").select(F.col("source").alias("s"), "size", up.alias("up"), F.shiftright("h", shift).alias("bucket"))
    inside = rows.join(edge.select("source", "prefix", "rest"), F.col("s").eqNullSafe(F.col("source")) & (F.col("up") == F.col("prefix")))
    sums = inside.groupBy("source", "rest", "bucket").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(W.partitionBy("source").orderBy("bucket"))
    over = sums.withColumn("upto", upto).where(F.col("upto") > F.col("rest"))
    first = over.groupBy("source").agg(F.min_by(F.struct("bucket", "upto", "words"), "bucket").alias("at"))
    found = first.select(F.col("source").alias("f_source"), F.col("at.bucket").alias("f_bucket"), (F.col("at.upto") - F.col("at.words")).alias("f_before"), F.col("at.words").alias("f_words"))
    joined = edge.drop("take_edge").join(found, F.col("source").eqNullSafe(F.col("f_source")), "left")
    none = F.shiftleft(F.col("prefix") + 1, BITS)  # the budget reaches past the last bucket: all of it is taken
    rest = F.col("rest") - F.coalesce("f_before", F.lit(0))
    out = joined.select(
        "source", "source_size", "target", "whole", rest.alias("rest"),
        F.when(F.col("source_size") == 0, F.lit(0).cast("long")).otherwise(F.coalesce("f_bucket", none)).alias("prefix"),
        F.coalesce(2 * rest >= F.col("f_words"), F.lit(False)).alias("take_edge"),
    )
    done = materialize(out, f"mix-level{level}")
    release(edge)
    return done
