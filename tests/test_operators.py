from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import ground, html, integrity, lexical, providers, ranking, selection, vector
from tessera.sources import manifest, sinks


def test_bm25_formula(spark):
    docs = spark.createDataFrame([(1, "k", "tax tax due"), (2, "k", "tax paid"), (3, "k", "penalty due"), (4, "other", "tax")], "id long, key string, text string")
    q = spark.createDataFrame([(9, "k", "tax")], "qid long, key string, text string")
    rows = lexical.rank(lexical.lengths(docs), q).orderBy("rank").collect()
    assert [r["id"] for r in rows] == [1, 2, 3] and rows[2]["score"] == 0
    idf, avg = math.log(1 + (4 - 3 + 0.5) / 3.5), 8 / 4
    assert rows[0]["score"] == pytest.approx(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avg)))


def test_rrf_and_ranks(spark):
    def ranking_of(ids):
        return spark.createDataFrame([(1, i, r + 1) for r, i in enumerate(ids)], "qid int, id string, rank int")

    got = [r["id"] for r in ranking.rrf([ranking_of("bacde"), ranking_of("abfgh")]).orderBy("rank").collect()]
    assert got == ["a", "b", "c", "f", "d"]
    first = spark.createDataFrame([(1, 1), (2, 2), (3, 5), (4, None)], "qid int, first_rank int")
    m = first.agg(*ranking.metric_columns(F.col("first_rank"))).first()
    assert (m["precision_at_1"], m["mrr"], m["hits_at_5"]) == (0.25, 0.425, 3)
    ranks = spark.createDataFrame([(float(i),) for i in range(1, 21)], "x double")
    ranks = selection.nearest_ranks(ranks, [], "x", {"p95": 0.95}).first()
    assert (ranks["p95"], ranks["median"]) == (19, 10.5)


def test_vectors(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.1]), (3, 0, [0.0, 1.0]), (4, 1, [1.0, 0.0]), (5, 0, [0.0, 0.0]), (6, 0, [float("nan"), 1.0])], "id long, key int, e array<double>")
    assert [r["ok"] for r in rows.select(vector.is_valid(F.col("e"), 2).alias("ok")).collect()] == [True] * 5 + [False]
    v = rows.where(vector.is_valid(F.col("e"), 2)).withColumn("v", vector.unit(F.col("e"))).where("v is not null")
    top = vector.top_in_key(v, v.where("id = 1")).orderBy("rank").collect()
    assert [r["id"] for r in top] == [2, 3]


def test_bind_is_all_or_nothing(spark):
    body = "the quick brown fox jumps over the lazy dog"
    ev = spark.createDataFrame([(1, "a", body), (2, "a", body)], "answer_id int, chunk_id string, body string")
    claims = spark.createDataFrame([(1, 0, "x", "a", "quick  brown fox jumps"), (2, 0, "x", "a", "quick brown fox jumps"), (2, 1, "y", "b", "quick brown fox jumps"), (3, 0, "z", "a", "fox")], "answer_id int, pos int, text string, cited_id string, quote string")
    got = {r["answer_id"]: (r["status"], r["answer"], r["citations"]) for r in ground.bind(claims, ev).collect()}
    assert got == {1: ("answered", "x [C1]", "C1=a"), 2: ("refused", None, None), 3: ("refused", None, None)}


def test_faithfulness_is_null_unless_judged(spark):
    rows = spark.createDataFrame([("a", True), ("a", False), ("b", True), ("b", None)], "g string, label boolean")
    got = {r["g"]: r["faithfulness"] for r in ground.faithfulness(rows, "g", F.col("label"), F.col("label").isNotNull()).collect()}
    assert got == {"a": 0.5, "b": None}


PAGE = """<html><head><link rel="canonical" href="/c"><script>x()</script></head><body><nav>skip</nav><h1>Title</h1><article>
<h2>One</h2><p>Text with <a href="/l">link</a>.</p>loose <b>words</b><ul><li>first</li><li>second<ul><li>inner</li></ul></li></ul>
<h3 class="accordion-heading">FAQ</h3><table><caption>Cap</caption><tr><th>a</th><th>b</th></tr><tr><td>1|2</td></tr></table><ol><li>n1</li><li>n2</li></ol></article></body></html>"""


def test_html_blocks_and_markdown(spark):
    r = html.parsed(spark.createDataFrame([(1, "https://e.org/x", PAGE), (2, None, None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    md = r[0]["markdown"]
    assert r[0]["title"] == "Title" and r[0]["canonical"] == "https://e.org/c" and "skip" not in md and "x()" not in md
    assert "[link](https://e.org/l)" in md and "loose words" in md and "  - inner" in md and "1. n1\n2. n2" in md
    assert "| a | b |\n| --- | --- |\n| 1\\|2 |  |" in md and "\nCap\n" in md
    assert [b["is_faq"] for b in r[0]["blocks"] if b["kind"] == "h3"] == [True]
    assert r[1]["blocks"] == []


def test_integrity(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert {(r["k"], r["side"]) for r in integrity.parity(a, b, "k").collect()} == {(1, "missing"), (3, "extra")}
    d = spark.createDataFrame([(1, "# t\nSource: a\nbody"), (2, "# u\nSource: b\nbody"), (3, None)], "doc_id long, text string")
    g = integrity.duplicate_groups(d, integrity.body_only(F.col("text"))).collect()
    assert [(r["n"], r["first_id"], r["last_id"]) for r in g] == [(2, 1, 2)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes("﻿id,name\n1, a \n2,\n".encode())
    rows = [tuple(r) for r in manifest.read_csv(spark, str(tmp_path / "m.csv"), ["id", "name"]).collect()]
    assert rows == [("1", "a"), ("2", "")]
    with pytest.raises(manifest.ContractError):
        manifest.read_csv(spark, str(tmp_path / "m.csv"), ["other"])
    v = spark.createDataFrame([(1, 0.1), (2, 0.2)], "vec_id long, x double")
    sinks.upsert_vectors(spark, str(tmp_path / "v"), v, "n")
    sinks.upsert_vectors(spark, str(tmp_path / "v"), v.where("vec_id = 2").withColumn("x", F.lit(9.0)), "n")
    assert {tuple(r) for r in sinks.read_vectors(spark, str(tmp_path / "v"), "n").collect()} == {(1, 0.1), (2, 9.0)}
    sinks.write_jsonl(v, str(tmp_path / "j"), ["vec_id"])
    assert manifest.read_jsonl(spark, str(tmp_path / "j"), "vec_id long, x double").count() == 2
    assert sinks.leaks(spark.createDataFrame([("api_key=abcdefgh12",), ("fine",)], "t string")).count() == 1


def test_stand_ins(spark):
    e = spark.createDataFrame([("tax due",), ("",)], "t string").select(providers.hashed_bag_embedding(F.col("t"), 8).alias("e")).collect()
    assert sum(x * x for x in e[0]["e"]) == pytest.approx(1) and sum(e[1]["e"]) == 0
