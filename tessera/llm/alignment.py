"""Alignment of two tokenizers over whole texts: minimal groups of tokens, links, and how often an id pair is linked.

Tokens of both sides are the nodes of a bipartite graph, and tokens whose bytes overlap are
its edges. Its connected components, found by union-find, are the minimal groups: runs of
tokens of either side over the same bytes that no smaller cut divides. Members of a
component whose bytes end together are linked. The texts of a slice are one graph, as no
token reaches into another text.

Counts of id pairs are of the whole corpus. There are at most as many as the vocabularies'
product, too many to hand to every task, and a few of them stand in every text, too often to
be one key of a shuffle. So pairs that are frequent are looked up in a broadcast table of at
most FREQUENT rows, and only the others, each of which is rarer than those, are joined by
shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import arrow_schema, column_bytes, materialize, release, slices, small_batches, to_batch
from .tokens import encoder, token_bytes

FREQUENT = 1 << 18
SHIFT = 32  # a pair is (id of A << 32) | id of B
STEPS = 8  # classes of counts for each power of two


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- one slice --------------------------------------------------------------------------------


def union(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union-find over n nodes and edges (u, v): the least node of each node's component.

    All edges at once: roots are hung on the least root across an edge, paths are halved
    until every node points at its root, and edges inside of a component are dropped.
    """
    parent = np.arange(n)
    while len(u):
        a, b = parent[u], parent[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            over = parent[parent]
            if np.array_equal(over, parent):
                break
            parent = over
    return parent


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) for every j in lo[i] .. hi[i] - 1."""
    n = np.maximum(hi - lo, 0)
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + lo[i]


def groups_and_links(len_a: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two sequences of token lengths over the same bytes: the group of each token of A and of B (numbered from 0), and the linked tokens (i, j)."""
    end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
    i, j = spread(np.searchsorted(end_b, end_a - len_a, "right"), np.searchsorted(end_b - len_b, end_a, "left"))
    root = union(len(len_a) + len(len_b), i, j + len(len_a))
    number = np.cumsum(root == np.arange(len(root))) - 1
    group_a, group_b = number[root[: len(len_a)]], number[root[len(len_a) :]]
    i, j = spread(np.searchsorted(end_b, end_a, "left"), np.searchsorted(end_b, end_a, "right"))
    within = group_a[i] == group_b[j]
    return group_a, group_b, i[within], j[within]


@lru_cache(maxsize=1)
def _written_ids(n: int) -> list[str]:
    """Ids as text with what may follow them: a comma, a bar, a semicolon, nothing."""
    return [f"{i}{after}" for after in (",", "|", ";", "") for i in range(n)]


class Aligner:
    """Both tokenizers, made once a worker."""

    def __init__(self, path_a: str, path_b: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.a, self.bytes_a, self.bytes_b = encoder(path_a, added_tokens=False), token_bytes(path_a), token_bytes(path_b)
        model = SentencePieceProcessor(model_file=path_b)
        self.b = lambda text: np.array(model.encode(text, num_threads=1), np.int64)
        self.len_a, self.len_b = np.array([len(x) for x in self.bytes_a]), np.array([len(x) for x in self.bytes_b])
        self.written = _written_ids(max(len(self.bytes_a), len(self.bytes_b)))

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides; none if the bytes of either differ from a space and the text."""
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        a, b = self.a(" " + text).astype(np.int64), self.b(text)
        want = b" " + text.encode()
        for ids, data in ((a, self.bytes_a), (b, self.bytes_b)):
            if b"".join(map(data.__getitem__, ids.tolist())) != want:
                return none, none
        return a, b

    def slice(self, texts: list[str]) -> dict:
        """Columns n_a .. n_links, groups (as text), and the distinct pairs of each text with their number, as offsets, pairs, times."""
        found = [self.tokens(t) for t in texts]
        n_a, n_b = np.array([len(a) for a, _ in found], np.int64), np.array([len(b) for _, b in found], np.int64)
        a, b = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        group_a, group_b, i, j = groups_and_links(self.len_a[a], self.len_b[b])
        row_a, row_b = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
        first = np.ones(len(a), bool)
        first[1:] = group_a[1:] != group_a[:-1]
        n_groups = np.bincount(row_a[first], minlength=len(texts))
        n_links = np.bincount(row_a[i], minlength=len(texts))
        pair = (a[i] << SHIFT) | b[j]
        order = np.lexsort((pair, row_a[i]))
        pair, row = pair[order], row_a[i][order]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups": self.write(n_a + n_b, a, b, group_a, group_b, row_b),
            "offsets": np.searchsorted(row[at], np.arange(len(texts) + 1)), "pairs": pair[at], "times": np.diff(np.append(at, len(pair))),
        }

    def write(self, n: np.ndarray, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, row_b: np.ndarray) -> list[str]:
        """Of each text its groups: ids of A, a bar, ids of B, groups parted by semicolons."""
        more_a, more_b, last = np.zeros(len(a), bool), np.zeros(len(b), bool), np.ones(len(b), bool)
        more_a[:-1], more_b[:-1], last[:-1] = group_a[1:] == group_a[:-1], group_b[1:] == group_b[:-1], row_b[1:] != row_b[:-1]
        size = len(self.written) // 4
        code = np.concatenate([a + np.where(more_a, 0, size), b + np.where(more_b, 0, np.where(last, 3 * size, 2 * size))])
        code = code[np.argsort(np.concatenate([group_a, group_b]), kind="stable")].tolist()
        ends = np.cumsum(n).tolist()
        return ["".join(map(self.written.__getitem__, code[lo:hi])) for lo, hi in zip([0, *ends], ends, strict=False)]


@lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


# --- the corpus ---------------------------------------------------------------------------------


def frequent_from(classes: list[tuple[int, int]], most: int) -> int:
    """The least class of counts such that it and all higher ones have at most ``most`` pairs; classes: (class, pairs)."""
    least, total = 1 << 30, 0
    for c, n in sorted(classes, reverse=True):
        total += n
        if total > most:
            break
        least = c
    return least


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", with_groups: bool = True, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs`` (id, text): id, n_a, n_b, n_groups, n_links, n_best (links whose pair's count is the highest of its B id, ties included),
    count_sum (sum of the counts of its links' pairs), groups (``a1,a2|b1;a3|b2,b3``) or without ``with_groups`` null, and groups_sha256.

    Null and empty texts, and texts that either tokenizer changes, have no tokens: zeros and ''.
    Texts are tokenised whole, of any length. Repeated rows count each; ids may repeat or be
    null. No rows give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), "text")
    schema = StructType([rows.schema["id"], *StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, pairs array<long>, times array<int>").fields])
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _aligner(path_a, path_b)
        for batch in batches:
            data, off = column_bytes(batch.column("text"))
            for i, j in slices(off):
                got = tool.slice([data[off[r] : off[r + 1]].tobytes().decode() for r in range(i, j)])
                offsets = pa.array(got["offsets"], pa.int32())
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in got["groups"]]
                lists = {"pairs": pa.ListArray.from_arrays(offsets, pa.array(got["pairs"], pa.int64())), "times": pa.ListArray.from_arrays(offsets, pa.array(got["times"], pa.int32()))}
                lists = {k: x.cast(kinds.field(k).type) for k, x in lists.items()}
                groups = got["groups"] if with_groups else pa.nulls(j - i, pa.string())
                yield to_batch({k: got[k] for k in ("n_a", "n_b", "n_groups", "n_links")} | lists | {"id": batch.column("id").slice(i, j - i), "groups": groups, "groups_sha256": digests}, kinds)

    found = materialize(rows.mapInArrow(run, schema).withColumn("rid", F.monotonically_increasing_id()), "aligned")
    each = found.select("rid", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    sums = materialize(each.groupBy("pair").agg(F.sum("times").alias("count")), "pair-counts")
    b = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    highest = sums.groupBy(b.alias("b")).agg(F.max("count").alias("most"))  # one row an id of B's vocabulary
    level = F.floor(F.log2("count") * STEPS)
    counts = sums.join(F.broadcast(highest), b == F.col("b")).select(F.col("pair").alias("p"), "count", (F.col("count") == F.col("most")).alias("best"), level.cast("int").alias("level"))
    counts = materialize(counts, "pairs")
    release(sums)
    least = frequent_from([tuple(r) for r in counts.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()], frequent)  # STEPS rows for each power of two
    often, seldom = counts.where(F.col("level") >= least), counts.where(F.col("level") < least)

    def sums_of(linked: DataFrame) -> DataFrame:
        return linked.groupBy("rid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))

    known = sums_of(each.join(F.broadcast(often), F.col("pair") == F.col("p")))
    rest = each.join(F.broadcast(often.select("p")), F.col("pair") == F.col("p"), "left_anti")
    rare = sums_of(rest.join(seldom, F.col("pair") == F.col("p")))
    total = known.unionByName(rare).groupBy(F.col("rid").alias("r")).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = found.drop("pairs", "times").join(total, F.col("rid") == F.col("r"), "left")
    none = F.lit(0).cast("long")
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups", "groups_sha256")
