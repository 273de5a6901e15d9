"""Ranks of groups against sorted lists."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import selection


def plain(rows, share):
    groups: dict = {}
    for g, x in rows:
        if x is not None:
            groups.setdefault(g, []).append(x + 0.0)
    out = {}
    for g, v in groups.items():
        v.sort(key=lambda x: (math.isnan(x), x))
        n = len(v)
        out[g] = tuple(map(repr, (v[0], (v[(n + 1) // 2 - 1] + v[n // 2]) / 2, v[max(1, math.ceil(round(share * n, 9))) - 1], v[-1])))
    return out


@pytest.mark.parametrize("most_wanted", [0, selection.MOST_WANTED])
@pytest.mark.parametrize("share", [0.95, 0.0, 1.0])
def test_equals_sorting(spark, monkeypatch, most_wanted, share):
    """One group with most rows, one value with most of them, ties, signs, zeros, infinities, NaN, nulls, groups of one; wanted buckets broadcast or joined."""
    monkeypatch.setattr(selection.select_ranks, "__defaults__", (most_wanted,))
    rng = random.Random(3)
    some = [0.0, -0.0, 1.5, 1.5, -2.25, 1e300, -1e300, 5e-324, math.inf, -math.inf, 3.0]
    rows = [("hot", rng.choice([7.0, 7.0, rng.gauss(0, 1), rng.gauss(0, 1e9)])) for _ in range(3000)]
    rows += [(rng.choice("abcdefgh"), rng.choice(some)) for _ in range(300)] + [(None, 1.0), (None, 4.0), ("one", -7.5), ("none", None), ("nan", math.nan), ("nan", 1.0), ("nan", 2.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: tuple(map(repr, (r["min"], r["median"], r["p"], r["max"]))) for r in selection.nearest_ranks(df, ["g"], "x", {"p": share}).collect()}
    assert got == plain(rows, share)


def test_many_groups_and_none(spark):
    df = spark.range(20_000).select((F.col("id") % 7000).alias("g"), (F.col("id") * 37 % 1001).cast("double").alias("x"))
    got = {r["g"]: (r["min"], r["p"], r["max"]) for r in selection.nearest_ranks(df, ["g"], "x", {"p": 0.5}).collect()}
    groups: dict = {}
    for i in range(20_000):
        groups.setdefault(i % 7000, []).append(float(i * 37 % 1001))
    assert got == {g: (min(v), sorted(v)[math.ceil(len(v) / 2) - 1], max(v)) for g, v in groups.items()}
    assert selection.nearest_ranks(df.where("false"), ["g"], "x", {"p": 0.5}).collect() == []


def test_no_group_is_gathered(spark):
    """Plans of a hot group sum counts before the shuffle and sort no values."""
    df = spark.range(1000).select(F.lit("hot").alias("g"), F.col("id").cast("double").alias("x"))
    plan = selection.nearest_ranks(df, ["g"], "x", {"p": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_list" not in plan
