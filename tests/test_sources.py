from __future__ import annotations

import datetime
import json
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import chunk, runs, tokenwindows
from tessera.sources import contracts, manifest, publish, sinks, tables, versions
from tessera.sources.manifest import ContractError


def test_records_contract(spark):
    rows = [("S01", "a", "What is due?", "x"), ("S02", "b", "what  is due? ", None), ("S02", "b", "Other", None), ("S09", "c", "More", "y")]
    df = spark.createDataFrame(rows, "id string, kind string, question string, truth string")
    wrong = contracts.records(df, "id", ["id", "kind", "question", "truth"], ["S01", "S02", "S03"], {"kind": {"a": 1, "b": 1}}, {"truth": F.col("kind") == "c"}, "question")
    assert wrong == ["id S02 occurs 2 times", "id S03 is missing", "1 rows have other ids", "kind b: 2 rows instead of 1", "1 rows have another kind", "truth is null in the wrong 3 rows", "1 texts of question repeat"]
    assert contracts.records(df.limit(1), "id", ["id", "kind", "question", "truth"], ["S01"], {"kind": {"a": 1}}, {"truth": F.col("kind") == "c"}, "question") == []
    assert contracts.records(df, "id", ["id"])[0].startswith("columns are")


def test_heading_registry(spark, tmp_path):
    text = "# T\n## P\n" + " ".join(f"w{i}" for i in range(450)) + "\n## Q\nshort"
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(text.split("\n"))], "doc int, line int, text string")
    c = chunk.section_chunks(chunk.sections(lines)).withColumn("subchunk_total", F.when(F.col("section_index") == 0, 3).otherwise(1)).drop("heading_path", "chunk_text")
    sinks.write_jsonl(c, str(tmp_path / "r"), ["doc", "section_index", "subchunk_index"])
    back = manifest.read_jsonl(spark, str(tmp_path / "r"), c.schema)
    assert back.count() == 4 and contracts.heading_registry(back).count() == 0
    first = (F.col("section_index") == 0) & (F.col("subchunk_index") == 1)
    bad = back.withColumn("text", F.when(first, "changed").otherwise(F.col("text"))).withColumn("token_start", F.col("token_start") + F.when(F.col("subchunk_index") == 2, 1).otherwise(0))
    found = {(r["section_index"], r["subchunk_index"], r["rule"]) for r in contracts.heading_registry(bad).collect()}
    assert found == {(0, 1, "text_sha256"), (0, 1, "chunk_id"), (0, 2, "span"), (0, 2, "overlap")}


def test_configuration_and_files(tmp_path):
    contracts.same_configuration({"k": 5, "model": "a"}, {"k": 5, "model": "b"}, ["model"])
    with pytest.raises(ContractError, match="k, n"):
        contracts.same_configuration({"k": 5, "n": 1}, {"k": 6})
    assert contracts.safe_name("C:\\x\\..\\Notice.PDF", ".pdf") == "Notice.PDF"
    for name in ("", "..", "a/.hidden.pdf", "x.txt"):
        with pytest.raises(ContractError):
            contracts.safe_name(name, ".pdf")
    assert contracts.child(str(tmp_path), "a.txt") == str(tmp_path.resolve() / "a.txt")
    with pytest.raises(ContractError):
        contracts.child(str(tmp_path), "../a.txt")
    (tmp_path / "p").mkdir()
    (tmp_path / "env").write_text("# no\nA=1\nB='two'\n")
    assert contracts.settings(["A", "B"], {"A": "9"}, str(tmp_path / "env"), str(tmp_path / "p")) == {"A": "9", "B": "two"}
    with pytest.raises(ContractError, match="missing settings: C"):
        contracts.settings(["C"], {}, str(tmp_path / "env"), str(tmp_path / "p"))
    with pytest.raises(ContractError):
        contracts.settings(["A"], {}, str(tmp_path / "env"), str(tmp_path))


def test_measured_values_and_vectors(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.25), ("b", 0.25)], "name string, value double")
    assert contracts.measured(df, {"a": 0.5 + 1e-12}) == []
    assert contracts.measured(df, {"a": 0.5001, "b": 0.25, "c": 1.0}) == ["a: 0.5 instead of 0.5001", "b: 0.25 instead of 0.25", "c: missing instead of 1.0"]
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    contracts.vector_table(v, 2, 2)
    for rows, n in ((v.union(v), 4), (v, 3), (v.union(spark.createDataFrame([(3, [1.0])], v.schema)), 3)):
        with pytest.raises(ContractError):
            contracts.vector_table(rows, 2, n)


def test_publication_is_whole_or_undone(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "out")
    assert sorted(publish.publish(spark, folder, {"a.md": "one", "b.json": b"{}"})) == [f"{folder}/a.md", f"{folder}/b.json"]
    with pytest.raises(ContractError):
        publish.publish(spark, folder, {"a.md": "two", "c.md": "the sesame word"}, ["sesame"])
    with pytest.raises(ContractError):
        publish.publish(spark, folder, {"c.md": "api_key = 0123456789abcdef"})
    plain = publish.write_bytes

    def failing(s, path, data):
        if path.endswith("c.md"):
            raise OSError("disk full")
        plain(s, path, data)

    monkeypatch.setattr(publish, "write_bytes", failing)
    with pytest.raises(OSError):
        publish.publish(spark, folder, {"a.md": "two", "new.md": "x", "c.md": "y"})
    monkeypatch.undo()
    assert publish.read_bytes(spark, f"{folder}/a.md") == b"one" and publish.read_bytes(spark, f"{folder}/new.md") is None
    publish.write_json(spark, f"{folder}/x.json", {"b": 1, "a": "é"})
    assert json.loads(publish.read_bytes(spark, f"{folder}/x.json")) == {"b": 1, "a": "é"}
    assert publish.canonical_json({"b": [1, 2], "a": "é"}) == '{"a":"é","b":[1,2]}'
    df = spark.createDataFrame([(2, "x|y"), (1, None)], "n int, t string")
    assert publish.markdown_table(df, ["n"], "T") == "## T\n\n| n | t |\n| --- | --- |\n| 1 |  |\n| 2 | x\\|y |\n"
    assert "More than 1 rows" in publish.markdown_table(df, ["n"], "T", 1)


def test_pinned_files_and_whole_texts(spark, tmp_path):
    for name, content in (("a.md", b"alpha"), ("b.md", b"beta"), ("c.md", b"gamma")):
        (tmp_path / name).write_bytes(content)
    import hashlib

    ledger = spark.createDataFrame([("a.md", hashlib.sha256(b"alpha").hexdigest()), ("b.md", "0" * 64), ("z.md", "1" * 64)], "name string, sha256 string")
    got = {r["name"]: r["status"] for r in manifest.read_pinned(spark, str(tmp_path), ledger).collect()}
    assert got == {"a.md": "ok", "b.md": "changed", "c.md": "unlisted", "z.md": "absent"}
    assert sorted(r["text"] for r in manifest.read_whole_texts(spark, str(tmp_path)).collect()) == ["alpha", "beta", "gamma"]
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe\xfa")
    with pytest.raises(Exception, match="not UTF-8"):
        manifest.read_whole_texts(spark, str(tmp_path)).collect()


def test_csv_and_vectors(spark, tmp_path):
    (tmp_path / "m.csv").write_text("\ufeffid,name\n 1 ,\tA\u00a0\n2,\n")
    rows = manifest.read_csv(spark, str(tmp_path / "m.csv"), ["id", "name"]).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", "A"), ("2", "")]
    with pytest.raises(ContractError):
        manifest.read_csv(spark, str(tmp_path / "m.csv"), ["missing"])
    (tmp_path / "e.csv").write_text("id,name\n")
    with pytest.raises(ContractError, match="no rows"):
        manifest.read_csv(spark, str(tmp_path / "e.csv"), ["id"])
    v = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    sinks.upsert_vectors(spark, str(tmp_path / "v"), v, "n")
    sinks.upsert_vectors(spark, str(tmp_path / "v"), spark.createDataFrame([(2, [9.0]), (3, [3.0])], v.schema), "n")
    assert sorted((r["vec_id"], r["embedding"]) for r in sinks.read_vectors(spark, str(tmp_path / "v"), "n").collect()) == [(1, [1.0]), (2, [9.0]), (3, [3.0])]
    out = str(tmp_path / "o.csv")
    sinks.write_csv(v.select("vec_id"), out, ["vec_id"])
    assert spark.read.csv(out, header=True).count() == 2
    assert sinks.leaks(spark.createDataFrame([("token: abcdefgh12",), ("fine",)], "t string")).count() == 1


def test_charsets(spark):
    texts = ["“quoted” – 5 € é", '<meta charset="windows-1252">‘it’s’ … é', "plain é", '<meta charset="shift_jis">日本語', '<meta charset="koi8-r">привет', '<meta charset="nonsense">é', "\x00bin"]
    codes = ["cp1252", "cp1252", "utf-8", "shift_jis", "koi8-r", "utf-8", "utf-8"]
    pages = [(i, t.encode(c)) for i, (t, c) in enumerate(zip(texts, codes, strict=True))] + [(90, b"\x81\xff undecodable as either"), (91, None), (92, b"")]
    df = spark.createDataFrame(pages, "i int, content binary")
    got = {r["i"]: r["t"] for r in df.select("i", manifest.decode_html(df.content).alias("t")).collect()}
    assert [got[i] for i in range(len(texts))] == texts
    assert got[90] == b"\x81\xff undecodable as either".decode("utf-8", "replace") and got[91] is None and got[92] == ""


class Stopped(BaseException):
    pass


def test_a_stopped_run_is_resumed(spark, tmp_path, monkeypatch):
    """Errors become rows; models take turns; a run that is stopped between waves has each attempt once when it is resumed."""

    def call(model, case):
        if model == "bad":
            raise TimeoutError
        return f"{model}:{case}"

    cases = spark.createDataFrame([(f"c{i}", i) for i in range(6)] + [("c0", 0), (None, 7)], "case_id string, case_no long")
    plain, left = versions.upsert, [2]

    def failing(*a):
        left[0] -= 1
        if left[0] < 0:
            raise Stopped
        return plain(*a)

    monkeypatch.setattr(versions, "upsert", failing)
    root = str(tmp_path / "ledger")
    with pytest.raises(Stopped):
        runs.run_cases(spark, root, cases, ["good", "bad"], call, runs=2, wave=2)
    assert runs.ledger(spark, root).count() == 16
    monkeypatch.undo()
    for _ in range(2):  # the second time there is nothing left to do
        rows = runs.run_cases(spark, root, cases, ["good", "bad"], call, runs=2, wave=2).orderBy("turn").collect()
        assert versions.current(spark, root) == 3
    assert len(rows) == 24 and len({(r["model"], r["case_id"], r["run"]) for r in rows}) == 24
    assert {(r["model"], r["status"], r["error"]) for r in rows} == {("good", "ok", None), ("bad", "error", "TimeoutError")}
    assert all(r["value"] == (f"good:{r['case_id']}" if r["model"] == "good" else None) for r in rows)
    first = [r["model"] for r in rows][::2]
    assert first == ["good", "bad"] * 3 + ["bad", "good"] * 3
    assert runs.run_cases(spark, str(tmp_path / "none"), cases.where("false"), ["good"], call).count() == 0


def test_first_acceptable_and_probe(spark):
    c = spark.createDataFrame([("x", 1, "a", False), ("x", 2, "b", True), ("x", 3, "c", True), ("y", 1, "a", False), (None, 1, "q", True)], "g string, o int, m string, ok boolean")
    got = {r["g"]: (r["chosen"], r["rejected"]) for r in runs.first_acceptable(c, "g", "o", "m").collect()}
    assert got == {"x": ("b", 1), "y": (None, 1), None: ("q", 0)}

    def ask(model, passage):
        if model == "b":
            raise OSError
        return model == "c"

    assert runs.probe(["z", "b", "a", "c"], ["a", "b", "c"], ask) == "c" and runs.probe(["z"], ["a"], ask) is None


def test_token_windows(spark):
    encode, decode = tokenwindows.tokenizer(tokenwindows.default_path())
    text = "The notice says: pay €1,234.50 by March 5 — naïve 日本語 \U0001f600 " * 60
    ids = encode(text)
    got = list(tokenwindows.token_windows(ids, encode, decode))
    assert got[0][0] == 0 and got[-1][1] == len(ids) and all(len(again) <= 220 for *_, again in got)
    assert all(b[0] == a[1] - 40 for a, b in zip(got, got[1:], strict=False)) and all(x == decode(ids[a:b]) for a, b, x, _ in got)
    rare = encode("\u9fc3\U0001fae8" * 150)  # several tokens a character: cuts fall within characters
    cut = list(tokenwindows.token_windows(rare, encode, decode))
    assert any(again != rare[a:b] for a, b, _, again in cut) and all(len(again) <= 220 for *_, again in cut) and cut[-1][1] == len(rare)
    df = spark.createDataFrame([(1, text), (2, None), (3, " \n"), (4, "short")], "doc_id long, text string")
    rows = tokenwindows.token_chunks(df, tokenwindows.default_path()).collect()
    assert {r["doc_id"] for r in rows} == {1, 4} and [(r["token_start"], r["token_end"], r["chunk_text"]) for r in rows if r["doc_id"] == 1] == [(a, b, x) for a, b, x, _ in got]
    assert all(r["chunk_id"] == f"{r['doc_id']}__tokens_220_40__{r['ordinal']:06d}__{r['text_sha256']}" for r in rows)


def test_written_tables(spark):
    df = tables.written(spark.createDataFrame([(1, "a")], "x int, y string"), "t")
    assert [tuple(r) for r in df.collect()] == [(1, "a")]


def test_csv_quotes_and_line_ends(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes('\ufeffid,text\r\n1,"a ""quoted"" word"\r\n2,"two\nlines, one value"\r\n3, back\\slash \r\n4,\r\n'.encode())
    assert [tuple(r) for r in manifest.read_csv(spark, str(tmp_path / "m.csv"), ["id", "text"]).collect()] == [("1", 'a "quoted" word'), ("2", "two\nlines, one value"), ("3", "back\\slash"), ("4", "")]


def test_catalog(spark):
    kinds = "code string, file string, url string, language string"
    rule = {"unique": ["code", "file"], "values": {"language": "English"}, "prefixes": {"url": "https://example.org/"}, "n": 2, "files": "file"}
    good = [("A", "a.pdf", "https://example.org/a", "English"), ("B", "b.PDF", "https://example.org/b", "English")]
    assert contracts.catalog(spark.createDataFrame(good, kinds), **rule) == []
    bad = [("A", "../a.pdf", "http://example.org/a", "English"), ("A", "b.txt", "https://example.org/b", None), (" ", "c.pdf", None, "French")]
    assert contracts.catalog(spark.createDataFrame(bad, kinds), **rule) == ["3 rows instead of 2", "code is blank or repeated", "language is wrong in 2 rows", "url is wrong in 2 rows", "file is no file name in 2 rows"]
    assert contracts.catalog(spark.createDataFrame(good, kinds).drop("url"), **rule)[0].startswith("columns are")


def test_utc_timestamp(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        row = spark.sql("select timestamp'2024-07-01 00:30:00' as t").select(text.utc_timestamp(F.col("t")).alias("x"), text.utc_timestamp().alias("now")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert row["x"] == "2024-07-01T04:30:00Z"
    assert abs(datetime.datetime.fromisoformat(row["now"]).timestamp() - time.time()) < 60
