"""Canonical exact digest of documents, from DataFrame functions alone.

A text is brought to one form (Unicode compatibility normalisation, full case folding,
white space runs to one space, ends trimmed) and digested with xxhash of two seeds, 128
bits. Documents are grouped by digest and canonical text together: the hash decides the
bucket, and within equal buckets the aggregation compares the bytes, so texts that only
share a digest stay apart. Copies are combined before the shuffle, so a group that holds
a third of all rows costs each task one row.

Normalisation and case folding are static methods of the ICU library that Spark ships
with, called by the SQL function ``reflect``; rows stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize, partitions

SEEDS = ("first lane", "second lane")
BUCKETS_PER_PARTITION = 8


def canonical(text: Column) -> Column:
    """The canonical form of a text; null is empty."""
    folded = _nfkc(F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), _nfkc(F.coalesce(text, F.lit(""))), F.lit(True)))
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}\x{85}]+", " "))


def _nfkc(text: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def digest(canon: Column) -> Column:
    """128 bits in lowercase hex. Hashing a seed first makes it the seed of the text's hash."""
    return F.lower(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(s), canon)), 16, "0") for s in SEEDS)))


def likeness(a: Column, b: Column) -> Column:
    """Of two exact digests: 1.0 if equal, else 0.0."""
    return F.when(a == b, 1.0).otherwise(0.0)


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of documents with the same canonical text: fingerprint, first_doc_id, copies.

    Two rows have the same fingerprint only if two different canonical texts collide.
    Null texts count as empty and form one group; an empty table has no groups.
    """
    c = docs.select(F.col(doc_id).alias("doc_id"), canonical(F.col(text)).alias("canon"))
    grouped = c.groupBy(digest(F.col("canon")).alias("fingerprint"), "canon").agg(F.min("doc_id").alias("first_doc_id"), F.count(F.lit(1)).alias("copies"))
    return grouped.select("fingerprint", "first_doc_id", "copies")


def with_next(docs: DataFrame, key: str, value: str, n_buckets: int) -> DataFrame:
    """Each row with ``next_value``, the value of the next row in descending key order; after the last comes the first.

    A range partition in one shuffle: quantiles of the keys bound the buckets, the row that
    opens a bucket is also sent to the bucket above as its border, and each bucket is then a
    window of its own. The borders are one row a bucket (``n_buckets``), which bounds
    what is broadcast. Null keys come last; ties are ordered by the hash of the value.
    """
    low = F.lit(-(2**63)).cast("long")
    k = docs.withColumn("_key", F.coalesce(F.col(key).cast("long"), low))
    quantiles = k.select(F.percentile_approx("_key", [i / n_buckets for i in range(1, n_buckets)] or [0.5], 10 * n_buckets).alias("q")).first()
    bounds = sorted(set(quantiles["q"] or []))
    k = k.withColumn("_bucket", _bucket(F.col("_key"), bounds))
    heads = {r["_bucket"]: r["head"] for r in k.groupBy("_bucket").agg(F.max("_key").alias("head")).collect()}
    if not heads:
        return docs.withColumn("next_value", F.col(value))
    order = sorted(heads)
    border = [(heads[order[i - 1]], b) for i, b in enumerate(order)]  # of the lowest bucket: the very first row
    borders = docs.sparkSession.createDataFrame(border, "_head long, _target int")
    borders = borders.groupBy("_head").agg(F.collect_list("_target").alias("_targets"))
    sent = k.join(F.broadcast(borders), F.col("_key") == F.col("_head"), "left")
    places = F.concat(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("border"))), F.coalesce(F.transform("_targets", lambda t: F.struct(t.alias("b"), F.lit(True).alias("border"))), F.array().cast("array<struct<b:int,border:boolean>>")))
    sent = sent.withColumn("_at", F.explode(places)).drop("_head", "_targets")
    w = W.partitionBy("_at.b").orderBy("_at.border", F.desc("_key"), F.xxhash64(value))
    return sent.withColumn("next_value", F.lead(value).over(w)).where("not _at.border").drop("_key", "_bucket", "_at")


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most the key, by a search in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*(F.lit(r[0]).cast("long") for r in rows))
    table = F.array(*(F.array(*(F.lit(x).cast("long") for x in r)) for r in rows))
    row = F.size(F.filter(heads, lambda x: x <= key))
    inner = F.size(F.filter(F.element_at(table, row), lambda x: x <= key))
    return F.when(row == 0, 0).otherwise((row - 1) * step + inner).cast("int")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents and of their edited texts.

    The edited text of a document has its last floor(n_chars / 2) code points replaced by
    the first as many (or all) of the next document in descending doc_id order. Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, and of the document's group first_doc_id, copies and collisions (other
    canonical texts with the same digest, told apart by their bytes; first_doc_id and
    copies are then of the whole bucket). An exact digest is all or nothing, so the
    likenesses are 1.0 or 0.0. Null texts are empty; a single document is its own next.
    """
    n = partitions(docs.sparkSession)
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("v", F.struct("text", digest(canonical(F.col("text"))).alias("fp"))).select("doc_id", "v")
    d = with_next(d, "doc_id", "v", BUCKETS_PER_PARTITION * n)
    half = F.floor(F.length("v.text") / 2).cast("int")
    edited = F.concat(F.substring("v.text", F.lit(1), F.length("v.text") - half), F.substring("next_value.text", F.lit(1), half))
    d = d.withColumn("edited", edited)
    own, other = F.col("v.fp"), digest(canonical(F.col("edited")))
    rows = d.select(
        "doc_id", F.length("v.text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        own.alias("fingerprint"), other.alias("edited_fingerprint"), F.col("next_value.fp").alias("next_fp"),
    )
    rows = materialize(rows, "fingerprints")
    groups = exact_groups(docs).groupBy("fingerprint").agg(F.min("first_doc_id").alias("first_doc_id"), F.sum("copies").alias("copies"), (F.count(F.lit(1)) - 1).alias("collisions"))
    groups = materialize(groups, "fingerprint-groups")
    return rows.join(groups, "fingerprint", "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fp")).alias("near_next"),
        "first_doc_id", "copies", "collisions",
    )
