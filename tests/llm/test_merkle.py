from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from oracle import DATA, check
from pyspark.sql import functions as F

from tessera.llm import merkle, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """The root and each leaf's siblings, level by level from whole lists."""
    path, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, place in enumerate(at):
            if place ^ 1 < len(level):
                path[i].append((place & 1, level[place ^ 1]))
            else:
                path[i].append(None)
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
        at = [p // 2 for p in at]
    return level[0], path


def fold(x, path):
    for step in path:
        x = h(x) if step is None else h(step[1], x) if step[0] else h(x, step[1])
    return x


def leaf(r, more=0):
    values = [r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + more, r["text"]]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain(rows):
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    inner = {}
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        inner[g] = tree([leaf(r) for r in groups[g]])
    root, outer = tree([inner[g][0] for g in order]) if order else (None, [])
    out = []
    for g, above in zip(order, outer, strict=True):
        for r, path in zip(groups[g], inner[g][1], strict=True):
            whole = [*path, *above]
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            folded = fold(leaf(r, bad), whole)
            out.append((r["doc_id"], leaf(r), inner[g][0], root, h(*(x[1] for x in whole if x)), folded, folded == root))
    return sorted(out, key=repr)


KINDS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root int"


def made(n, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["s", None]), rng.choice(["en", "en", "en", "de", None]), rng.choice([3, None, 2**63 - 1]), rng.choice(["", None, "grün", "x" * 50_000])) for i in range(n)]
    return [(*r, "x", 1) for r in rows + rows[:3]]


@pytest.mark.parametrize(("n", "height"), [(0, 9), (1, 9), (41, 2), (90, 9)])
def test_manifest_equals_whole_lists(spark, n, height):
    """Nulls, long texts, repeated rows, further columns with clashing names, one group with most rows; few and many levels of blocks."""
    rows = made(n, n) + ([(None, None, "zz", None, None, None, None), (7, "s", "", 1, "t", None, None)] if n else [])
    docs = spark.createDataFrame(rows, KINDS)
    got = merkle.manifest(docs, *merkle.tampered(docs), height=height).withColumn("proof_sha256", F.sha2("proof", 256))
    got = [tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted(got, key=repr) == plain([r.asDict() for r in docs.collect()])


@pytest.mark.parametrize("n", range(1, 70))
def test_traversal_of_a_block(n):
    leaves = [h(str(i)) for i in range(n)]
    root, paths = tree(leaves)
    for height in {merkle.levels(n), merkle.levels(n) + 2}:
        got = [list(p) for p in merkle.traverse(leaves, height)]
        assert [[x and x[1] for x in p] + [None] * (height - merkle.levels(n)) for p in paths] == got
        assert {merkle.climb(x, p, i) for i, (x, p) in enumerate(zip(leaves, got, strict=True))} == {merkle.block_root(leaves, height)}
    assert merkle.block_root(leaves, merkle.levels(n)) == root


def test_memory_of_a_block_is_logarithmic():
    leaves, most = [h(str(i)) for i in range(512)], 0
    t = merkle.Treehash(0, 9, 512)
    while t.step(leaves):
        most = max(most, len(t.stack))
    assert most <= 10


def test_written_paths():
    path = [h("a"), None, h("b"), None]
    for place in (0, 1, 4, 5):
        back, bits = merkle.read_path(merkle.write_path(path, place))
        assert back == path and merkle.climb(h("x"), back, bits) == merkle.climb(h("x"), path, place)


def test_query_equals_sql_and_whole_lists(spark):
    check(spark, queries.op11_merkle, queries.ORACLE_SQL["op11_merkle"])
    rows = [r.asDict() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = queries.op11_merkle(spark, DATA).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)
