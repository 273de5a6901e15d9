"""A stored index of unit vectors in cells, searched exactly within the cells that a query asks.

Centroids are fitted by spherical k-means to at most SAMPLE rows, those with the least hash of
the id; every row is then in the list of its nearest centroid. How many cells a query asks is
calibrated on the sample, so that the share of true neighbours found there reaches a target:
clustered vectors need few, vectors without structure most. All cells give the exact result.

Lists are cut into parts of about PART rows and the queries of a cell into blocks of as many, so
a task holds one part and one block, whatever the size of a cell or the number of queries.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructType

from tessera.sources import tables
from tessera.sources.manifest import ContractError

from .index import version
from .vector import best_of_part, cosines, matrix

SAMPLE, MOST_CELLS, ROUNDS = 20_000, 1024, 8
PART = 8192
TOP, RECALL = 5, 0.97
LAYOUT = 1  # of the stored tables; part of an index's name


def fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means from evenly spaced rows of the sample (which is in the order of a hash); a cell that empties keeps its centroid."""
    centroids = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)] if len(sample) else sample
    for _ in range(ROUNDS if len(sample) else 0):
        near = (sample @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 0, sums / np.where(size > 0, size, 1), centroids)
    return centroids


def calibrate(sample: np.ndarray, keys: list, centroids: np.ndarray, recall: float = RECALL, top: int = TOP, asked: int = 500) -> int:
    """The least number of cells, asked by the first rows of the sample, with which the share of their true neighbours of equal key within the sample reaches ``recall``."""
    if not len(sample):
        return 1
    codes = np.unique([repr(k) for k in keys], return_inverse=True)[1]
    q = np.arange(min(asked, len(sample)))
    scores = np.where(codes[q][:, None] == codes[None, :], sample[q] @ sample.T, -np.inf)
    scores[q, q] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :top]
    real = np.isfinite(np.take_along_axis(scores, best, 1))
    cell = (sample @ centroids.T).argmax(1)
    order = np.argsort(np.argsort(-(sample[q] @ centroids.T), axis=1), axis=1)
    place = np.sort(np.take_along_axis(order, cell[best], 1)[real])
    return int(place[min(len(place) - 1, int(np.ceil(recall * len(place))) - 1)]) + 1 if len(place) else len(centroids)


@dataclass
class Cells:
    """lists: cell, part, id, key, v; centroids; sizes (cell, rows); and what it was built as: dimension, metric, count, probes."""

    lists: DataFrame
    centroids: np.ndarray
    sizes: dict[int, int]
    meta: dict

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Cells:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # at most MOST_CELLS
        return cls(spark.read.parquet(f"{path}/lists"), np.array([r["centroid"] for r in rows]), {r["cell"]: r["rows"] for r in rows}, meta)


def nearest(rows: DataFrame, centroids: np.ndarray, n: int) -> DataFrame:
    """``rows`` (id, key, v), one for each of the n nearest cells (column ``cell``)."""
    schema = StructType([rows.schema[c] for c in ("id", "key", "v")]).add("cell", IntegerType())
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = matrix(batch.column("v")) @ centroids.T
            cells = np.argpartition(-near, n - 1, axis=1)[:, :n] if n < len(centroids) else np.tile(np.arange(len(centroids)), (batch.num_rows, 1))
            at = pa.array(np.repeat(np.arange(batch.num_rows), cells.shape[1]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("id", "key", "v")), pa.array(cells.ravel(), pa.int32())], schema=kinds)

    return rows.select("id", "key", "v").mapInArrow(run, schema)


def least_hashes(rows: DataFrame, count: int) -> DataFrame:
    """The SAMPLE rows with the least hash of the id, in that order. Every task of a sort with a limit would send that many to the driver, so what is sorted are only hashes below a bound that some more rows reach; should they be too few, all are."""
    h = F.xxhash64("id")
    if count > 2 * SAMPLE:
        few = rows.where(h < int(-(2**63) + 2**64 * 1.1 * SAMPLE / count))
        if few.count() >= SAMPLE:
            rows = few
    return rows.orderBy(h, "id").limit(SAMPLE)


def build(rows: DataFrame, path: str, cells: int | None = None, recall: float = RECALL) -> None:
    """Write the index of unit vectors (id, key, v) to a folder. Rows without a vector are not in it."""
    spark = rows.sparkSession
    rows = rows.where("v is not null")
    count = rows.count()
    sample = least_hashes(rows, count).select("key", "v").collect()
    vectors = np.array([r["v"] for r in sample], np.float64)
    centroids = fit(vectors, cells or max(1, min(MOST_CELLS, round(count**0.5))))
    probes = calibrate(vectors, [r["key"] for r in sample], centroids, recall)
    placed = tables.written(nearest(rows, centroids, 1), "placed") if count else rows.withColumn("cell", F.lit(0))
    sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = F.element_at(F.lit(np.array([max(1, -(-sizes.get(c, 0) // PART)) for c in range(max(1, len(centroids)))])).cast("array<int>"), F.col("cell") + 1)
    lists = placed.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).repartitionByRange("cell", "part").sortWithinPartitions("cell", "part")
    lists.select("cell", "part", "id", "key", "v").write.parquet(f"{path}/lists")
    spark.createDataFrame([(c, x.tolist(), sizes.get(c, 0)) for c, x in enumerate(centroids)], "cell int, centroid array<double>, rows long").coalesce(1).write.parquet(f"{path}/centroids")
    meta = {"dimension": vectors.shape[1] if len(vectors) else 0, "metric": "cosine", "count": count, "cells": len(centroids), "sample": len(vectors), "probes": probes}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/meta")


def stored(rows: DataFrame, of: str) -> Cells:
    """The index of vectors read from files, as they are now: built once under another name, then renamed."""
    spark = rows.sparkSession
    path = f"{tables.shared_dir(spark)}/tessera/cells-{LAYOUT}-{of}-{version(rows)}"
    target, fs = tables.file_system(spark, path)
    if not fs.exists(target):
        part = f"{path}.{uuid.uuid4().hex}"
        build(rows, part)
        source, _ = tables.file_system(spark, part)
        if fs.exists(target) or not fs.rename(source, target):
            fs.delete(source, True)
    return Cells.read(spark, path)


def verify(index: Cells, dimension: int, count: int, metric: str = "cosine") -> None:
    """Raise ContractError unless the index has this dimension, metric and number of vectors, in its description and in its lists."""
    wrong = [f"{k} is {index.meta[k]}, not {v}" for k, v in (("dimension", dimension), ("metric", metric), ("count", count)) if index.meta[k] != v]
    found = index.lists.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("v") != dimension).alias("odd")).first()
    if found["n"] != count or sum(index.sizes.values()) != count:
        wrong.append(f"lists hold {found['n']} vectors, not {count}")
    if found["odd"]:
        wrong.append(f"{found['odd']} vectors of another dimension")
    if wrong:
        raise ContractError("; ".join(wrong))


def search(index: Cells, queries: DataFrame, top: int = TOP, probes: int | None = None) -> DataFrame:
    """qid, id, score (cosine, nine digits), rank: the best rows of each query's key (queries: id, key, v), the query itself left out.

    ``probes`` cells are asked for each query, by default as calibrated; as many as there are give the exact result.
    """
    n = min(probes or index.meta["probes"], len(index.centroids))
    kind = {f.name: f.dataType.simpleString() for f in index.lists.schema}
    out = f"qid {kind['id']}, id {kind['id']}, score double"
    if not n:
        return queries.sparkSession.createDataFrame([], out + ", rank int")
    q = tables.written(nearest(queries.where("v is not null and key is not null"), index.centroids, n), "asked")
    asked = {r["cell"]: r["n"] for r in q.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a cell
    cells = range(len(index.centroids))
    parts = F.lit([max(1, -(-index.sizes.get(c, 0) // PART)) for c in cells]).cast("array<int>")
    blocks = F.lit([max(1, -(-asked.get(c, 0) // PART)) for c in cells]).cast("array<int>")

    def each(numbers):  # 0 .. the cell's number - 1
        return F.explode(F.sequence(F.lit(0), F.element_at(numbers, F.col("cell") + 1) - 1))

    rows = index.lists.where(F.col("cell").isin(list(asked))).withColumn("block", each(blocks))
    q = q.withColumn("block", F.pmod(F.xxhash64("id"), F.element_at(blocks, F.col("cell") + 1)).cast("int")).withColumn("part", each(parts))

    by = ("cell", "part", "block")
    pairs = rows.groupBy(*by).cogroup(q.groupBy(*by)).applyInArrow(lambda left, right: best_of_part(left, right, top, cosines), out)
    r = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return pairs.withColumn("rank", r).where(F.col("rank") <= top)
