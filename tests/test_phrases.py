"""Phrases in texts against plain containment."""

from __future__ import annotations

import random
import time

import pytest

from tessera.operators import phrases
from tessera.plans import corpus


def brute(texts, wanted):
    return sorted((p, i) for i, t, *_ in texts for p, q in wanted if q and t and q in t)


def found(spark, texts, wanted, **more):
    t = spark.createDataFrame(texts, "id long, text string, number int, phrase string")
    p = spark.createDataFrame(wanted, "phrase_id long, phrase string")
    return sorted((r["phrase_id"], r["id"]) for r in phrases.contained(t, p, **more).collect())


@pytest.mark.parametrize("part_bytes", [1, 60, phrases.PART_BYTES])
def test_equals_containment(spark, part_bytes):
    """Phrases within phrases, overlaps, ties, nulls and empties, equal phrases, repeated texts; one part or many."""
    rng = random.Random(2)
    words = ["ab", "abc", "bc", "über", "ü", "a", "b a"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), 1, "x") for i in range(40)]
    texts += [(None, None, 1, "x"), (90, "", 1, "x"), (3, texts[3][1], 1, "x")]
    wanted = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))) for i in range(25)] + [(100, "abc"), (101, "abc"), (102, None), (103, "")]
    assert found(spark, texts, wanted, part_bytes=part_bytes) == sorted(brute(texts, wanted), key=lambda x: (x[0], x[1] if x[1] is not None else -1))
    if part_bytes == 60:
        p = phrases.numbered(spark.createDataFrame(wanted, "phrase_id long, phrase string"), 60).collect()
        sizes: dict = {}
        for r in p:
            sizes.setdefault(r["part"], []).append(len(r["phrase"].encode()))
        assert len(sizes) > 1 and all(sum(x) <= 60 or len(x) == 1 for x in sizes.values())
        assert len({r["number"] for r in p}) == len(p)


def test_no_rows(spark):
    assert found(spark, [], [(1, "abc")]) == [] and found(spark, [(1, "abc", 1, "x")], []) == []


def test_long_texts_take_time_in_proportion(spark, tmp_path):
    """Texts of 120,000 bytes without a space to cut at, and of many words."""
    long = [(1, "word of text " * 10_000 + "the passage that is looked for here", "en", "s", 1), (2, "x" * 120_000, "en", "s", 1)]
    spark.createDataFrame(long, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "the  passage that is\nlooked for here"), (8, "word of text " * 300)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    began = time.time()
    assert {(r["item_id"], r["doc_id"]) for r in corpus.quote_containment(spark, str(tmp_path)).collect()} == {(7, 1), (8, 1)}
    assert time.time() - began < 30
