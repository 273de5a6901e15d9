"""The stored index against scoring every document."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import index, lexical


def corpus(spark, n, seed):
    """Most documents have one key; words with a long tail, some in few documents; null and empty texts and null keys."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = [(i, rng.choice(["k", "k", "k", "l", None]), " ".join(rng.choices(words, weights, k=rng.randint(0, 40)))) for i in range(n)]
    rows += [(n, "k", None), (n + 1, "l", ""), (n + 2, "alone", "w1 w2")]
    docs = spark.createDataFrame(rows, "id long, key string, text string")
    asked = [(q, rng.choice(["k", "l", "alone", "nobody"]), " ".join(rng.choices(words, k=rng.randint(0, 6)))) for q in range(40)] + [(90, None, "w1"), (91, "k", "unheard of"), (92, "k", "w1 w1 w0"), (93, "k", None)]
    return docs, spark.createDataFrame(asked, "qid long, key string, text string")


def ranking(df):
    return sorted((r["qid"], r["rank"], r["id"], round(r["score"], 8)) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_search_equals_scoring_all(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(index, "BLOCK", 16)
    docs, asked = corpus(spark, 1200, seed)
    index.build(docs, f"{tmp_path}/i")
    report: dict = {}
    found = index.Index.read(spark, f"{tmp_path}/i")
    assert ranking(index.search(found, asked, report=report)) == ranking(lexical.rank(lexical.lengths(docs), asked))
    print(report)
    assert 0 < report["scored"] < 0.95 * report["cells"]
    want = docs.select("id", F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), " "))).alias("term")).where("term <> ''").groupBy("term").count()
    assert sorted(map(tuple, found.terms.collect())) == sorted(map(tuple, want.collect()))


def test_no_documents_and_no_queries(spark, tmp_path):
    docs, asked = corpus(spark, 5, 1)
    index.build(docs.where("false"), f"{tmp_path}/e")
    assert index.search(index.Index.read(spark, f"{tmp_path}/e"), asked).count() == 0
    index.build(docs, f"{tmp_path}/i")
    assert index.search(index.Index.read(spark, f"{tmp_path}/i"), asked.where("false")).count() == 0


def test_plans_read_only_what_they_need(spark, tmp_path):
    docs, asked = corpus(spark, 50, 1)
    index.build(docs, f"{tmp_path}/i")
    found = index.Index.read(spark, f"{tmp_path}/i")
    q = index.query_terms(found, asked)
    plan = index.bounds(found, q, [3])._jdf.queryExecution().toString()
    scan = next(x for x in plan.split("FileScan parquet")[1:] if "most#" in x.split("Batched")[0])
    assert "bucket" in scan.split("PartitionFilters")[1].split("PushedFilters")[0] and "tf#" not in scan.split("Batched")[0]


def test_stored_is_reused_and_follows_its_files(spark, tmp_path):
    docs, asked = corpus(spark, 60, 3)
    path = f"{tmp_path}/docs"
    docs.coalesce(1).write.parquet(path)
    a = index.stored(spark.read.parquet(path), "test")
    b = index.stored(spark.read.parquet(path), "test")
    assert a.docs.inputFiles() == b.docs.inputFiles()
    docs.limit(10).coalesce(1).write.mode("append").parquet(path)
    c = index.stored(spark.read.parquet(path), "test")
    assert c.docs.count() == 73 and set(c.docs.inputFiles()).isdisjoint(a.docs.inputFiles())
