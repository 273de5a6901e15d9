"""What the driver holds after a model has been learnt."""

from __future__ import annotations

from pathlib import Path

import numpy as np
from test_models import toy

from tessera.llm import shared, toxicity


def resident() -> int:
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096


def test_freed_memory_is_given_back():
    begun = resident()
    kept = []
    for _ in range(3000):  # blocks below the size that goes back by itself, with small ones that stay between them
        kept.append((np.ones(12_000), np.ones(10)))
    held = resident() - begun
    kept = [b for _, b in kept]
    shared.give_back()
    assert held > 200e6 and resident() - begun < 0.3 * held
    assert len(kept) == 3000


def test_learning_gives_back(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(toxicity, "give_back", lambda: calls.append(1))
    rows = [(i, text, label) for i, (text, label) in enumerate(toy(120))]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    assert toxicity.learn(docs, labels) is not None
    assert calls
