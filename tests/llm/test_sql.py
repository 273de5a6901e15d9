"""SQL of op1, op4 and op7 on rows of which many are linked: the given tables hold few such rows, or none."""

from __future__ import annotations

import random

import pytest
from oracle import check

from tessera.llm import queries


@pytest.fixture(scope="module")
def linked(spark, tmp_path_factory) -> str:
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["Éa", "日本", "ÀB"]

    def text(n: int) -> list[str]:
        return [rng.choice(words) for _ in range(n)]

    passage, common, texts = " ".join(text(40)), " ".join(text(12)), [None, "", " \t\n", "one", "ONE", "one two three", "a b c d", "A B C D", "x" * 49, "x" * 50, "x" * 400, "x" * 400]
    for _ in range(40):
        base = text(rng.randrange(20, 200))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(3)):  # near copies and exact ones
            copy = list(base)
            for i in rng.sample(range(len(copy)), rng.randrange(3)):
                copy[i] = rng.choice(words)
            texts.append(rng.choice([" ", "\n", "  "]).join(copy))
        texts.append(" ".join(text(15)) + passage + " ".join(text(15)) + rng.choice(["", common]))
    texts.append(" ".join(text(9000)))
    rng.shuffle(texts)
    docs = [(i if i % 17 else 3, t, "en", "s", 0) for i, t in enumerate(texts)]  # some rows repeat a doc_id
    vectors: list[tuple] = [(900, None, 1), (901, [0.0, 0.0, 0.0, 0.0], 1), (902, [1.0, None, 0.0, 0.0], 1), (903, [float("nan"), 1.0, 0.0, 0.0], 1), (904, [1.0, 0.0, 0.0, 0.0], None), (905, [], 1)]
    for i in range(120):
        v = [rng.gauss(0, 1) for _ in range(16)]
        for k in range(rng.randrange(1, 5)):
            near = [x * (1 + k) + rng.gauss(0, 0.03) * k for x in v]
            vectors.append((5 * i + k if i % 10 else 7, near, i % 3))
    folder = str(tmp_path_factory.mktemp("linked"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op4_embeddings", "op7_minhash"])
def test_linked_rows_equal_sql(spark, linked, name):
    assert check(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], linked) > 100
    rows = queries.QUERIES[name](spark, linked).collect()
    assert sum(r["n_removed"] > 0 if name == "op1_suffix_dedup" else not r["kept"] for r in rows) > 30
