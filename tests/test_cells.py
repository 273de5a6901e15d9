"""The cell index against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from oracle import DATA
from pyspark.sql import functions as F

from tessera.operators import cells
from tessera.plans import registry
from tessera.sources.manifest import ContractError

KINDS = "id long, key string, v array<double>"


def made(spark, n, groups, seed=0):
    """Unit vectors around ``groups`` centres (0: none), most with one key, some repeated, some without key or vector."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 16)) * (0.3 if groups else 1)
    if groups:
        v += rng.normal(size=(groups, 16))[rng.integers(0, groups, n)]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, str(rng.choice(["a", "a", "b", ""])) or None, x.tolist()) for i, x in enumerate(v)]
    rows += [(n, "a", rows[0][2]), (n + 1, "a", rows[0][2]), (n + 2, "b", None)]
    return rows, spark.createDataFrame(rows, KINDS)


def exact(rows, asked, top=5):
    out = set()
    for q, key, v in asked:
        if v is not None and key is not None:
            found = sorted((-round(float(np.dot(v, w)), 9), i) for i, k, w in rows if k == key and i != q and w is not None)[:top]
            out |= {(q, i, r + 1) for r, (_, i) in enumerate(found)}
    return out


@pytest.mark.parametrize("part", [7, cells.PART])
def test_all_cells_are_exact_and_calibrated_cells_nearly(spark, tmp_path, monkeypatch, part):
    monkeypatch.setattr(cells, "PART", part)
    rows, df = made(spark, 900, 12)
    cells.build(df, f"{tmp_path}/i")
    index = cells.Cells.read(spark, f"{tmp_path}/i")
    cells.verify(index, 16, 902)
    asked = [r for r in rows if r[0] % 20 == 0 or r[0] >= 900]
    q = spark.createDataFrame(asked, KINDS)
    want = exact(rows, asked)
    assert {(r["qid"], r["id"], r["rank"]) for r in cells.search(index, q, probes=len(index.centroids)).collect()} == want
    few = {(r["qid"], r["id"]) for r in cells.search(index, q).collect()}
    assert len(few & {(a, b) for a, b, _ in want}) >= 0.9 * len(want)
    assert index.meta["probes"] < len(index.centroids) / 2


def test_verify_names_what_is_wrong(spark, tmp_path):
    _, df = made(spark, 50, 3)
    cells.build(df, f"{tmp_path}/i")
    index = cells.Cells.read(spark, f"{tmp_path}/i")
    for wrong in ({"dimension": 17, "count": 52}, {"dimension": 16, "count": 51}, {"dimension": 16, "count": 52, "metric": "dot"}):
        with pytest.raises(ContractError):
            cells.verify(index, **wrong)
    index.lists = index.lists.limit(3)
    with pytest.raises(ContractError):
        cells.verify(index, 16, 52)


def test_no_vectors(spark, tmp_path):
    _, df = made(spark, 5, 0)
    cells.build(df.where("false"), f"{tmp_path}/i")
    assert cells.search(cells.Cells.read(spark, f"{tmp_path}/i"), df).collect() == []


def test_recall_on_the_given_table(spark):
    rows = registry.QUERIES["cell_index_recall"](spark, DATA).agg(F.sum("found").alias("f"), F.sum("nearest").alias("n")).first()
    assert rows["n"] > 0 and rows["f"] >= 0.9 * rows["n"]
