"""Digest trees: what differs is found from the top, and only there."""

from __future__ import annotations

import random

import pytest

from tessera.operators import integrity


@pytest.mark.parametrize("seed", range(4))
def test_changed_rows_equal_a_plain_comparison(spark, seed):
    """Changes, losses, additions, negative, repeated and null keys, trees of different heights, empty versions."""
    rng = random.Random(seed)
    a = {rng.randint(-50, 3000): "x" for _ in range(400)} if seed else {}
    b = dict(a)
    for k in rng.sample(sorted(a), 6 if a else 0):
        b.pop(k)
    b |= {rng.randint(-50, 100_000): "y" for _ in range(5)}
    def frame(d):
        return spark.createDataFrame([*d.items(), (None, "z"), (9, "twice"), (9, "twice")], "key long, digest string")

    got = {r["key"]: r["status"] for r in integrity.changed_rows(frame(a), frame(b), width=4).collect()}
    want = {k: "added" if k not in a else "lost" if k not in b else "changed" for k in a.keys() | b.keys() if a.get(k) != b.get(k)}
    if 9 in want:  # there are other rows of that key in both
        want[9] = "changed"
    assert got == want
    assert integrity.changed_rows(frame(b), frame(b), width=4).collect() == []


def test_a_changed_row_is_read_from_one_leaf(spark):
    a = spark.range(20_000).selectExpr("id as key", "'x' as digest")
    b = a.selectExpr("key", "case when key = 777 then 'y' else digest end as digest")
    ta, tb = integrity.digest_tree(a, 16), integrity.digest_tree(b, 16)
    assert [r["node"] for r in integrity.differing_leaves(ta, tb).collect()] == [777 // 16]
    assert ta.where("level = 0").count() == 1250 and ta.agg({"level": "max"}).first()[0] == 3
