from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import DATA, check  # noqa: E402

from tessera.llm import fingerprint, mixing, queries, url_filter  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    check(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], DATA)


def python_plan(df, *names):
    text = df._jdf.queryExecution().executedPlan().toString()
    return any(w in text for w in ("Python", "Pandas", "Arrow", *names))


@pytest.mark.parametrize("name", ["op2_url_filters", "op3_mixing", "op9_fingerprints"])
def test_native(spark, name):
    assert not python_plan(queries.QUERIES[name](spark, DATA))


def test_mixing_meets_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix_sources(docs).collect()
    taken, target, largest = Counter(), {}, Counter()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    for r in rows:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        target[s], largest[s] = r["target"], max(largest[s], r["size"])
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert sum(target.values()) == pytest.approx(sum(r["size"] for r in rows))


def test_mixing_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 5), (1, "a b", "s", 5), (None, None, None, 1), (2, "", "t", 1), (3, "x " * 5000, None, 2)], "doc_id long, text string, source string, target int")
    rows = mixing.mix_sources(docs, with_rows=True).collect()
    assert sorted(r["size"] for r in rows) == [0, 0, 2, 2, 5000] and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert {r["row"]["target"] for r in rows} == {1, 2, 5}
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_water_filling(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 20), (None, 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 30 and got["c"] == 60 and got[None] == 0 and got["b"] == pytest.approx(1030 - 90)


def test_canonical_form(spark):
    cases = ["ﬁne  TEXT", " Straße\t①", "é", "é", "", None, "x y", "İ", "a​b"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").select("i", fingerprint.canonical(F.col("t")).alias("c")).collect()
    for r in rows:
        text = cases[r["i"]] or ""
        want = " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())
        assert r["c"] == want, (text, r["c"])


def test_fingerprints_equal_brute_force(spark):
    import hashlib

    texts = [(i * 7 % 50, f"Text {i % 9} " * (i % 13)) for i in range(50)] + [(60, None), (61, ""), (62, "ТЕКСТ " * 30), (63, "текст " * 30)]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, canon int").repartition(7)
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_report(df).collect()}
    order = sorted(((i, t or "") for i, t in texts), reverse=True)
    canon = {i: " ".join(unicodedata.normalize("NFKC", t or "").casefold().split()) for i, t in texts}
    copies = Counter(canon.values())
    for k, (i, t) in enumerate(order):
        n, text = order[(k + 1) % len(order)]
        half = len(t) // 2
        edited = t[: len(t) - half] + text[:half]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_next"] == float(canon[i] == canon[n]) and r["copies"] == copies[canon[i]] and r["collisions"] == 0
    assert len({r["fingerprint"] for r in got.values()}) == len(copies)


def test_fingerprints_empty_and_single(spark):
    one = spark.createDataFrame([(None, "abc")], "doc_id long, text string")
    r = fingerprint.fingerprint_report(one).first()
    assert r["near_next"] == 1.0 and r["n_chars"] == 3
    assert fingerprint.fingerprint_report(one.limit(0)).count() == 0


def test_url_filter_history(spark):
    captures = spark.sql("""select * from values (1, 'https://A.b.example.com/x', timestamp'2024-02-01'), (2, 'https://a.b.example.com/x', timestamp'2024-04-01'),
      (3, 'https://b.example.com/x', timestamp'2024-05-02'), (4, 'not a url', timestamp'2024-05-02'), (5, null, null), (1, 'https://A.b.example.com/x', timestamp'2024-02-01'),
      (6, 'http://other.org/en/1', timestamp'2024-05-02'), (7, 'http://example.com', timestamp'2030-05-02') as t(page_id, url, fetch_time)""")
    entries = spark.sql("""select * from values ('example.com', timestamp'2024-01-15', 'block'), ('example.com', timestamp'2024-03-15', 'allow'), ('b.example.com', timestamp'2024-05-01', 'block'),
      ('other.org/en', timestamp'2024-05-02', 'block'), ('other.org', timestamp'2024-01-01', 'allow'), (null, timestamp'2024-01-01', 'block') as t(pattern, listed_at, action)""")
    rows = {r["page_id"]: r for r in url_filter.filter_captures(captures, entries, ("2024-01-01", "2024-12-01")).collect()}
    assert {i: r["kept"] for i, r in rows.items()} == {1: False, 2: True, 3: False, 4: True, 5: True, 6: False, 7: True}
    assert rows[1]["n_rows"] == 2 and rows[6]["matched"] == "other.org/en" and rows[2]["action"] == "allow"


def test_url_filter_at_any_time_and_in_any_zone(spark):
    rows = [(1, "http://a.org/x", 1704067200), (2, "http://a.org/x", 1735689599), (3, "http://a.org/x", 1900000000), (4, "http://a.org/x", 1000000000), (5, "http://b.org", 1700000000)]
    listed = [("a.org", 1704067200, "block"), ("b.org", 1600000000, "block"), ("b.org", 1700000000, "allow")]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/Los_Angeles", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", z)
            captures = spark.createDataFrame(rows, "page_id long, url string, t long").selectExpr("page_id", "url", "timestamp_seconds(t) as fetch_time")
            entries = spark.createDataFrame(listed, "pattern string, t long, action string").selectExpr("pattern", "timestamp_seconds(t) as listed_at", "action")
            out = url_filter.filter_captures(captures, entries, ("2024-01-01", "2024-12-01"))
            assert {r["page_id"]: r["kept"] for r in out.collect()} == {1: False, 2: False, 3: False, 4: True, 5: True}, z
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
