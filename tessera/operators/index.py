"""A stored inverted index for BM25 with an exact filter key, and top-k search that skips blocks.

The index is written once per corpus, into a folder named after the files it was made from:

- ``docs``: id, key, tokens (distinct) and their counts, n (all tokens), block. The documents of a key are dealt by a hash of the id to
  blocks of about BLOCK, the same for all terms.
- ``postings``: one row per term and document: its count and the document's length; sorted by
  term, key and block, in BUCKETS folders by a hash of the term.
- ``blocks``: one row per term, key and block: ``most``, the largest weight that the term has in a
  document there, without the query's part; in the same order and folders.
- ``terms``: term, df. ``stats``: number of documents, mean length.

A search reads the folders of its terms only. From the maxima alone it sums, for each query and
block, the most that a document there could score. The best SEEDS blocks of a query are
scored first; the k-th score found is a bound that later blocks must reach, and only those
that can are read and scored. The result is that of scoring all documents.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources import tables

from .lexical import K1, TOP, B, asked_terms, corpus_stats, counted, first_ids, idf

BLOCK, BUCKETS, SEEDS = 256, 64, 2
LAYOUT = 3  # of the stored tables; part of an index's name
MOST_KEYS = 100_000  # keys whose sizes are broadcast (some 5 MB); more are joined by shuffle
SLACK = 1e-6  # between a sum of maxima and a sum of weights


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def weight(tf: Column, n: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / avgdl))


@dataclass
class Index:
    docs: DataFrame
    postings: DataFrame
    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        docs = spark.read.parquet(f"{path}/docs")
        kind = {f.name: f.dataType.simpleString() for f in docs.schema}
        place = f"term string, key {kind['key']}, block bigint, "  # no postings leave no file to read a schema from
        postings = spark.read.schema(place + f"id {kind['id']}, tf int, n int, bucket int").parquet(f"{path}/postings")
        blocks = spark.read.schema(place + "most double, size bigint, bucket int").parquet(f"{path}/blocks")
        return cls(docs, postings, blocks, *(spark.read.parquet(f"{path}/{t}") for t in ("terms", "stats")))


def build(docs: DataFrame, path: str) -> None:
    """Write the index of rows (id, key, text) to a folder that does not exist yet. Null texts are empty; null keys are a key that no query has."""
    spark = docs.sparkSession
    sizes = tables.written(docs.groupBy(F.col("key").alias("k")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), "keys")
    lens = counted(docs)
    dealt = lens.join(F.broadcast(sizes) if sizes.count() <= MOST_KEYS else sizes, F.col("key").eqNullSafe(F.col("k"))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).drop("k", "blocks")
    tables.write(dealt, f"{path}/docs")
    tables.release(sizes)
    lens = spark.read.parquet(f"{path}/docs")
    tables.write(corpus_stats(lens).coalesce(1), f"{path}/stats")  # one row
    stats = spark.read.parquet(f"{path}/stats")
    place = ["bucket", "term", "key", "block"]
    each = lens.select("id", "key", "n", "block", F.inline(F.arrays_zip("tokens", "counts"))).withColumnsRenamed({"tokens": "term", "counts": "tf"}).withColumn("bucket", bucket(F.col("term")))
    # dealt by range once, so files are sorted by folder and term, and a frequent term is many tasks
    tables.write(each.repartitionByRange(*place).sortWithinPartitions(*place, "id"), f"{path}/postings", ["bucket"])
    postings = spark.read.schema(each.schema).parquet(f"{path}/postings").crossJoin(F.broadcast(stats))  # one row
    most = postings.groupBy(*place).agg(F.max(weight(F.col("tf"), F.col("n"), F.col("avgdl"))).alias("most"), F.count(F.lit(1)).alias("size"))
    tables.write(most.repartitionByRange(*place).sortWithinPartitions(*place), f"{path}/blocks", ["bucket"])
    tables.write(spark.read.schema(most.schema).parquet(f"{path}/blocks").groupBy("term").agg(F.sum("size").alias("df")), f"{path}/terms")


def version(files: DataFrame) -> str:
    """A name for the state of a table's files: their paths, lengths and times."""
    spark, seen = files.sparkSession, []
    for name in sorted(files.inputFiles()):
        p, fs = tables.file_system(spark, name)
        s = fs.getFileStatus(p)
        seen.append(f"{name} {s.getLen()} {s.getModificationTime()}")
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()[:32]


def stored(docs: DataFrame, of: str) -> Index:
    """The index of rows (id, key, text) read from files: the one there is for them as they are now, or a new one.

    It is built under another name and renamed when whole, so no reader meets half an index;
    if two sessions build it, the first to finish wins. ``of`` says what the rows are.
    """
    spark = docs.sparkSession
    path = f"{tables.shared_dir(spark)}/tessera/index-{LAYOUT}-{of}-{version(docs)}"
    target, fs = tables.file_system(spark, path)
    if not fs.exists(target):
        part = f"{path}.{uuid.uuid4().hex}"
        build(docs, part)
        source, _ = tables.file_system(spark, part)
        if fs.exists(target) or not fs.rename(source, target):
            fs.delete(source, True)
    return Index.read(spark, path)


def query_terms(index: Index, queries: DataFrame) -> DataFrame:
    """qid, q_key, term, factor (idf and count in the query) of queries (qid, key, text); terms that no document has fall out."""
    q = asked_terms(queries)
    df = index.terms.select(F.col("term").alias("t"), "df")
    j = q.join(df, F.col("term") == F.col("t")).crossJoin(F.broadcast(index.stats))  # one row
    return j.select("qid", "q_key", "term", (F.col("qf") * idf(F.col("n_docs"), F.col("df"))).alias("factor"), bucket(F.col("term")).alias("bucket"))


def bounds(index: Index, q: DataFrame, folders: list[int]) -> DataFrame:
    """qid, block, bound: the most that a document of a query's key and a block can score. Reads the maxima, no document."""
    p = index.blocks.where(F.col("bucket").isin(folders)).select(F.col("term").alias("t"), "key", "block", "most")
    j = q.join(p, (F.col("term") == F.col("t")) & (F.col("q_key") == F.col("key")))
    return j.groupBy("qid", "q_key", "block").agg(F.sum(F.col("factor") * F.col("most")).alias("bound"))


def scored(index: Index, q: DataFrame, cells: DataFrame, folders: list[int]) -> DataFrame:
    """qid, id, score of all documents in cells (qid, block) that have a term of the query."""
    c = cells.select(F.col("qid").alias("c_qid"), F.col("block").alias("c_block"))
    wanted = q.join(c, F.col("qid") == F.col("c_qid")).select("qid", "q_key", "term", "factor", "c_block")
    p = index.postings.where(F.col("bucket").isin(folders)).select(F.col("term").alias("t"), "key", "block", "id", "tf", "n")
    j = wanted.join(p, (F.col("term") == F.col("t")) & (F.col("q_key") == F.col("key")) & (F.col("c_block") == F.col("block")))
    return j.crossJoin(F.broadcast(index.stats)).groupBy("qid", "id").agg(F.sum(F.col("factor") * weight(F.col("tf"), F.col("n"), F.col("avgdl"))).alias("score"))  # the stats are one row


def best(scores: DataFrame, top: int) -> DataFrame:
    """The best ``top`` of each query; score (to nine digits) desc, id asc."""
    r = F.row_number().over(W.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "id"))
    return scores.withColumn("rank", r).where(F.col("rank") <= top)


def search(index: Index, queries: DataFrame, top: int = TOP, seeds: int = SEEDS, report: dict | None = None) -> DataFrame:
    """qid, id, score, rank: the best ``top`` documents of each query's key (qid, key, text), as ``lexical.rank`` gives them.

    Scores are by statistics of the whole corpus. Documents without a common term score zero
    and are kept; only the first ``top`` ids of a key can be among the best of those.
    ``report`` gets the numbers of blocks that could score and that were scored.
    """
    q = tables.written(query_terms(index, queries), "query-terms")
    folders = [r["bucket"] for r in q.select("bucket").distinct().collect()]  # at most BUCKETS
    cells = tables.written(bounds(index, q, folders), "bounds")
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("bound"), "block"))
    seeded = cells.withColumn("place", place).where(F.col("place") <= seeds)
    first = tables.written(scored(index, q, seeded, folders), "seeds")
    least = best(first, top).where(F.col("rank") == top).select(F.col("qid").alias("l"), F.col("score").alias("least"))
    begun = seeded.select(F.col("qid").alias("s_qid"), F.col("block").alias("s_block"))
    rest = cells.join(begun, (F.col("qid") == F.col("s_qid")) & (F.col("block") == F.col("s_block")), "left_anti").join(least, F.col("qid") == F.col("l"), "left")
    rest = tables.written(rest.where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - SLACK).select("qid", "block"), "cells")
    if report is not None:
        report |= {"cells": cells.count(), "scored": seeded.count() + rest.count()}
    s = first.unionByName(scored(index, q, rest, folders))
    keys = queries.select(F.col("key").alias("q_key")).distinct()
    zeros = queries.select("qid", "key").join(first_ids(index.docs.join(keys, F.col("key") == F.col("q_key"), "left_semi"), top), F.col("key") == F.col("k")).select("qid", "id", F.lit(0.0).alias("score"))
    both = s.unionByName(zeros).groupBy("qid", "id").agg(F.max("score").alias("score"))
    return best(both, top)
