"""Exact vector search within a filter key, and checks of vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOP = 5


def is_valid(v: Column, dimension: int) -> Column:
    """Of the given dimension, with finite numbers only."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dimension) & finite, F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length one, so that a cosine is a dot product; null if its length is zero."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


BUCKETS, PART, QUERIES_AT_ONCE = 1024, 8192, 256
NO_SCORE = -1e300  # of a pair with a null vector, which comes after all others


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, or of a column of numbers; a null row is zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_list(column.type) and not pa.types.is_large_list(column.type):
        return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, 1)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), len(flat) // max(1, there.sum())))
    out[there] = flat.reshape(there.sum(), -1) if there.any() else 0
    return out


def cosines(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return queries @ rows.T


def nearness(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of single numbers."""
    return -np.abs(queries - rows.T)


def _codes(left: pa.ChunkedArray, right: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Equal numbers for equal values of two columns."""
    both = pa.chunked_array([*left.chunks, *right.chunks]).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return both[: len(left)], both[len(left) :]


def best_of_part(rows: pa.Table, queries: pa.Table, top: int, score: Callable) -> pa.Table:
    """qid, id, score (nine digits): of each query the best ``top`` of these rows with its key, equal scores by id, the query itself left out."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if rows.num_rows and queries.num_rows:
        (keys, q_keys), (ids, q_ids) = (_codes(rows.column(c), queries.column(c)) for c in ("key", "id"))
        order = np.argsort(rows.column("id").to_numpy(), kind="stable")
        order = order[np.argsort(keys[order], kind="stable")]
        q_order = np.argsort(q_keys, kind="stable")
        keys, ids, v = keys[order], ids[order], matrix(rows.column("v"))[order]
        none = ~rows.column("v").is_valid().to_numpy()[order]
        w, q_none = matrix(queries.column("v")), ~queries.column("v").is_valid().to_numpy()
        q_sorted = q_keys[q_order]
        for key in np.unique(q_sorted):
            lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
            mine = q_order[np.searchsorted(q_sorted, key) : np.searchsorted(q_sorted, key, "right")]
            for k in range(0, len(mine) if hi > lo else 0, QUERIES_AT_ONCE):
                some = mine[k : k + QUERIES_AT_ONCE]
                s = np.round(score(w[some], v[lo:hi]), 9) + 0.0
                s[q_none[some][:, None] | none[lo:hi][None, :]] = NO_SCORE
                s[q_ids[some][:, None] == ids[lo:hi][None, :]] = -np.inf
                least = np.partition(s, -min(top, hi - lo), axis=1)[:, -min(top, hi - lo)]
                i, j = np.nonzero((s >= least[:, None]) & np.isfinite(s))
                value = s[i, j]
                sort = np.lexsort((j, -value, i))
                i, j, value = i[sort], j[sort], value[sort]
                first = np.searchsorted(i, i)
                kept = np.arange(len(i)) - first < top
                found.append((some[i[kept]], order[lo + j[kept]], value[kept]))
    i, j, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return pa.table({"qid": queries.column("id").take(pa.array(i)), "id": rows.column("id").take(pa.array(j)), "score": pa.array(s, pa.float64(), mask=s <= NO_SCORE)})


def top_in_key(rows: DataFrame, queries: DataFrame, top: int = TOP, score: Callable = cosines) -> DataFrame:
    """qid, id, score, rank: the best rows (id, key, v) of each query's key, the query itself left out.

    Keys are dealt to at most BUCKETS buckets by hash, so many small ones go together; the rows of a
    bucket to parts and its queries to blocks of about PART, so a task holds one part and one block
    whatever the size of a key, and only the best ``top`` of a query in a part leave it. No pair
    is a row of a sort. ``score``: from matrices of queries and rows to the matrix of their scores.
    """
    kind = rows.schema["id"].dataType.simpleString()
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int").alias("bucket")
    r, q = (x.where("key is not null").select("id", "key", "v", bucket) for x in (rows, queries))

    def pieces(x: DataFrame) -> Column:
        n = {b["bucket"]: b["n"] for b in x.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most BUCKETS
        return F.element_at(F.lit(np.array([max(1, -(-n.get(b, 0) // PART)) for b in range(BUCKETS)])).cast("array<int>"), F.col("bucket") + 1)

    parts, blocks = pieces(r), pieces(q)
    r = r.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    q = q.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    by = ("bucket", "part", "block")
    pairs = r.groupBy(*by).cogroup(q.groupBy(*by)).applyInArrow(lambda left, right: best_of_part(left, right, top, score), f"qid {kind}, id {kind}, score double")
    n = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return pairs.withColumn("rank", n).where(F.col("rank") <= top)
