"""What a Python worker holds at once, and what is shuffled."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import html, integrity, phrases, tokenwindows

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_batches_of_whole_texts_are_small(spark):
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>") for i in range(100)], "page_id long, url string, html string")
    some = spark.createDataFrame([(1, "b c")], "phrase_id long, phrase string")
    for make in (lambda: html.parsed(pages), lambda: phrases.contained(docs, some, "doc_id"), lambda: tokenwindows.token_chunks(docs, tokenwindows.default_path())):
        spark.conf.unset(ROWS)
        df = make()
        assert 0 < int(spark.conf.get(ROWS)) <= 512
        assert df.count() > 0


def test_pages_are_parsed_in_slices(spark):
    pages = spark.createDataFrame([(i, str(i), f"<p>{i}</p>") for i in range(3 * html.AT_ONCE + 5)], "page_id long, url string, html string").coalesce(1)
    got = html.parsed(pages).select("page_id", "url").collect()
    assert sorted((r["page_id"], r["url"]) for r in got) == [(i, str(i)) for i in range(3 * html.AT_ONCE + 5)]


def test_windows_are_encoded_by_the_fast_engine():
    from tokenizers import Tokenizer

    path = tokenwindows.default_path()
    encode, decode = tokenwindows.tokenizer(path)
    slow = Tokenizer.from_file(path)
    for ids in ([0, 1], encode("naïve 日本語 🙂")[1:-1], [*encode("a"), 0, *encode(" b")], list(range(130, 400))):
        assert decode(ids) == slow.decode(ids, skip_special_tokens=True)
    for text in ("", "Hello  world\n\n 12,5", "naïve café 日本語 <|endoftext|> x", "a" * 5000 + "\t \t"):
        assert encode(text) == slow.encode(text, add_special_tokens=False).ids
    assert encode.__closure__ and "tessera.llm.tokens" in {c.cell_contents.__module__ for c in encode.__closure__}


def test_kept_coverage_equals_multisets_and_shuffles_no_token(spark):
    docs = spark.createDataFrame([(1, "a b\na b\nb c"), (2, " \n"), (3, "x\nx\nx y"), (1, "a a\nq\nq"), (None, "n\nn")], "doc_id long, text string")
    once = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    got = integrity.kept_coverage(docs, "doc_id", T.whitespace_tokens(F.col("text")), T.whitespace_tokens(once))
    once_rows = docs.select("doc_id", once.alias("text"))
    raw, kept = (d.select("doc_id", F.explode(T.whitespace_tokens(F.col("text"))).alias("token")) for d in (docs, once_rows))
    want = integrity.multiset_coverage(raw, kept, "doc_id", "token")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect())) and got.count() == 3
    assert "token" not in got._jdf.queryExecution().executedPlan().toString().split("Exchange")[1].split("\n")[0]
