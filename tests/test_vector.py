"""Exact search within a key, in parts and blocks, against scoring every pair."""

from __future__ import annotations

import random

import pytest

from tessera.operators import cells, vector

KIND = "id long, key string, v array<double>"


def rows_of(n, seed):
    """Two frequent keys, many rare ones, null keys and vectors, and equal vectors under several ids."""
    rng = random.Random(seed)
    some = [[rng.choice([-1.0, 0.5, 2.0]) for _ in range(3)] for _ in range(40)]
    keys = ["a"] * 10 + ["b"] * 6 + [None] + [f"k{i}" for i in range(12)]
    return [(i, rng.choice(keys), None if rng.random() < 0.03 else rng.choice(some)) for i in rng.sample(range(10 * n), n)]


def wanted(rows, queries, top=5):
    out = []
    for q, key, w in queries:
        s = [(i, None if v is None or w is None else round(sum(a * b for a, b in zip(v, w, strict=True)), 9)) for i, k, v in rows if k is not None and k == key and i != q]
        s.sort(key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
        out += [(q, n + 1, i, x) for n, (i, x) in enumerate(s[:top])]
    return sorted(out)


@pytest.mark.parametrize("part", [7, 8192])
def test_parts_equal_all_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(vector, "PART", part)
    monkeypatch.setattr(vector, "BUCKETS", 4)
    rows = rows_of(300, 3)
    asked = rows[:90]
    found = vector.top_in_key(spark.createDataFrame(rows, KIND), spark.createDataFrame(asked, KIND))
    assert sorted((r["qid"], r["rank"], r["id"], r["score"]) for r in found.collect()) == wanted(rows, asked)
    assert vector.top_in_key(spark.createDataFrame([], KIND), spark.createDataFrame(asked, KIND)).count() == 0


def test_no_pair_is_a_row_of_a_join(spark):
    """Pairs that met in a join were sorted for the rank, all of a task's in its memory."""
    rows = spark.createDataFrame(rows_of(60, 4), KIND)
    plan = vector.top_in_key(rows, rows)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "Join" not in plan


def test_sample_sends_little_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr(cells, "SAMPLE", 50)
    rows = spark.range(4000).repartition(16).selectExpr("id", "'k' as key", "array(1D, cast(id as double)) as v")
    want = [r["id"] for r in rows.selectExpr("id", "xxhash64(id) h").orderBy("h").limit(50).collect()]
    some = cells.least_hashes(rows, 4000)
    assert [r["id"] for r in some.collect()] == want
    assert "xxhash64" in some._jdf.queryExecution().optimizedPlan().toString().split("Filter")[1]
