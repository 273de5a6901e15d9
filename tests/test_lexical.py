"""BM25 in one pass over the texts: the ranking of scoring every document, without a shuffle of postings."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_index import corpus, ranking

from tessera.operators import lexical
from tessera.plans import retrieval


@pytest.mark.parametrize("seed", [4, 5])
def test_search_equals_rank(spark, seed):
    docs, asked = corpus(spark, 600, seed)
    found, postings = lexical.search(docs, asked)
    assert ranking(found) == ranking(lexical.rank(lexical.lengths(docs), asked))
    assert postings.where("term is null").count() == docs.count()
    words = {r["term"] for r in lexical.asked_terms(asked).collect()}
    assert {r["term"] for r in postings.where("term is not null").select("term").distinct().collect()} <= words


def test_no_documents_and_no_queries(spark):
    docs, asked = corpus(spark, 5, 1)
    assert lexical.search(docs.where("false"), asked)[0].count() == 0
    assert lexical.search(docs, asked.where("false"))[0].count() == 0


def test_postings_are_not_shuffled(spark):
    docs, asked = corpus(spark, 50, 1)
    terms = lexical.tables.written(lexical.asked_terms(asked), "asked")
    plan = lexical.asked_postings(docs, terms)._jdf.queryExecution().executedPlan().toString()
    assert "LeftOuter" in plan and "BroadcastHashJoin" in plan
    assert "hashpartitioning(term" not in plan and "rangepartitioning" not in plan


def test_document_frequencies(spark):
    docs, _ = corpus(spark, 200, 6)
    want = docs.select("id", F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), " "))).alias("term")).where("term <> ''").groupBy("term").count()
    assert sorted(map(tuple, lexical.document_frequencies(docs).collect())) == sorted(map(tuple, want.collect()))


def test_queries_write_no_index(spark, tmp_path, monkeypatch):
    """Each BM25 query reads the texts once; what it writes is of the questions' terms, not of the corpus."""
    monkeypatch.setattr(lexical.tables, "shared_dir", lambda spark: f"file://{tmp_path}")
    for query in (retrieval.bm25_stats, retrieval.rank_metrics, retrieval.rerank_reorder, retrieval.variant_failures):
        query(spark, "/root/testdata/sf0.001").collect()
    assert not list(tmp_path.glob("tessera/index-*"))
