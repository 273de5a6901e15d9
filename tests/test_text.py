from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import notice as N
from tessera.functions import text as T
from tessera.operators import chunk, notices


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_search_tokens(spark):
    assert one(spark, "ＴＡＸ Tax_tax Straße CAFÉ don’t", T.search_tokens) == ["tax", "tax", "tax", "strasse", "café", "don", "t"]
    assert one(spark, None, T.search_tokens) == []


def test_nfkc_clean(spark):
    assert one(spark, "( ﬁne​ ) [ x ]\n y", T.nfkc_clean) == "( fine ) [x] y"


def test_windows(spark):
    want = {0: [], 1: [(0, 1)], 220: [(0, 220)], 221: [(0, 220), (180, 221)], 400: [(0, 220), (180, 400)], 401: [(0, 220), (180, 400), (360, 401)], 500: [(0, 220), (180, 400), (360, 500)]}
    docs = spark.createDataFrame([(n, " ".join(f"t{i}" for i in range(n))) for n in want], "doc_id long, text string")
    got: dict = {n: [] for n in want}
    for r in chunk.fixed_chunks(docs).orderBy("doc_id", "ordinal").collect():
        got[r["doc_id"]].append((r["token_start"], r["token_end"]))
    assert got == want


def test_heading_stack(spark):
    text = "# T\n## P\nbody\n#### [Deep](x)\nbody\n```\n## fenced\n```\n### Sibling\nbody"
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(text.split("\n"))], "doc int, line int, text string")
    paths = [r["heading_path"] for r in chunk.sections(lines).orderBy("section_index").collect()]
    assert paths == [["P"], ["P", "Deep"], ["P", "Sibling"]]


def test_codes_and_dates(spark):
    code = [one(spark, c, N.normalize_code) for c in ("CP 503", "CP-503", "LTR 1058", "CP503AA")]
    assert code == ["CP503", "CP503", "LETTER1058", None]
    dates = [one(spark, d, N.canonical_date) for d in ("March 05, 2024", "3/5/2024", "03-05-24", "February 30, 2024", "within 30 days")]
    assert dates == ["March 5, 2024"] * 3 + [None, None]


def test_redaction_keeps_only_facts(spark):
    text = "JOHN Q DOE\n123 Main Street\nP.O. Box 12\nSSN 123-45-6789\nCaller ID: 99\n555-123-4567\nmail me@x.org\nYour balance is $10.00 in total"
    assert one(spark, text, N.redact) == "Your balance is $10.00 in total"


def test_identify(spark):
    rows = spark.createDataFrame([(1, "Notice CP503 / CP501"), (2, "we mention CP503 here"), (3, "Notice CP503\na\nb\nc\nd\ne\nabout CP14"), (4, "Letter\n1058"), (5, "Letter 1058 and LT11"), (6, None)], "notice_id int, text string")
    got = {r["notice_id"]: (r["status"], r["notice_code"]) for r in notices.identify(rows, ["CP503"]).collect()}
    assert got[1] == ("ambiguous", None) and got[2] == ("unidentified", None) and got[3] == ("identified", "CP503") and got[6] == ("unidentified", None)


def test_decode_html_reads_windows_1252(spark):
    from tessera.sources.manifest import decode_html

    texts = ["“quoted” – 5 € é", '<meta charset="windows-1252">‘it’s’ … é', "plain é"]
    pages = [(0, texts[0].encode("cp1252")), (1, texts[1].encode("cp1252")), (2, texts[2].encode())]
    df = spark.createDataFrame(pages, "i int, content binary")
    assert [r["t"] for r in df.select("i", decode_html(df.content).alias("t")).orderBy("i").collect()] == texts
