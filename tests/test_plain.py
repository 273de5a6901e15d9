"""Queries that SQL does not express, against plain Python over the same tables."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter

import duckdb
import pytest
from oracle import DATA

from tessera.functions import notice as N
from tessera.operators import html
from tessera.plans import registry


def rows(sql: str) -> list[tuple]:
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c.execute(sql).fetchall()


def sha(text: str | None) -> str | None:
    return None if text is None else hashlib.sha256(text.encode()).hexdigest()


def collect(spark, name: str) -> list:
    return registry.QUERIES[name](spark, DATA).collect()


def redacted(text: str) -> str:
    for pattern, sign in N.REDACTIONS:
        text = re.sub(pattern, lambda _, sign=sign: sign, text)
    out = []
    for line in text.splitlines():
        line = " ".join(line.split())
        holds = any(re.search(p, line) for p in (*N.LINE_HOLDS, *N.FORM_LABELS_IN))
        if line and not holds and not any(re.fullmatch(p, line) for p in (*N.LINE_IS, *N.FORM_LABELS)):
            out.append(line)
    return "\n".join(out)


def test_redact_pii(spark):
    want = {i: None if t is None else redacted(t) for i, t in rows("select doc_id, text from documents")}
    got = {r["doc_id"]: (r["redacted_sha256"], r["redactions"]) for r in collect(spark, "redact_pii")}
    assert got == {i: (sha(t), None if t is None else len(re.findall(r"\[REDACTED", t))) for i, t in want.items()}


@pytest.mark.parametrize("text", ["a\x0cSSN 123-45-6789\x0bb", "x P.O. Box 12 and more y", "John Smith\nkept words", "call 555-123-4567\x85next", "12345 street é\nÉtést line"])
def test_redaction_of_odd_lines(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(N.redact(df.t)).first()[0] == redacted(text)


def test_unicode_clean(spark):
    want = {}
    for i, t in rows("select doc_id, text from documents"):
        clean = None
        if t is not None:
            clean = " ".join(unicodedata.normalize("NFKC", t).replace("​", "").replace("­", "").split()).replace("[ ", "[").replace(" ]", "]")
        want[i] = (sha(clean), sha(None if t is None else t.casefold()))
    assert {r["doc_id"]: (r["nfkc_sha256"], r["folded_sha256"]) for r in collect(spark, "unicode_clean")} == want


def test_html_queries(spark):
    pages = {i: html.parse(u or "", h or "") for i, u, h in rows("select page_id, url, html from pages")}
    got = {r["page_id"]: (r["title"], r["markdown"], r["n_blocks"]) for r in collect(spark, "html_markdown")}
    assert got == {i: (p["title"], p["markdown"], len(p["blocks"])) for i, p in pages.items()}
    found: dict = {i: [] for i in pages}
    for r in collect(spark, "html_blocks"):
        found[r["page_id"]].append(r.asDict())
    for i, p in pages.items():
        assert [{k: b[k] for k in b if k != "page_id"} for b in sorted(found[i], key=lambda b: b["pos"])] == p["blocks"]
    for r in collect(spark, "html_quality_problems"):
        p = pages[r["page_id"]]
        kinds = Counter(b["kind"] for b in p["blocks"])
        pairs = [(b["kind"], b["text"]) for b in p["blocks"]]
        checks = [
            (p["title"] is None, "no title"), (p["canonical"] is None, "no canonical link"), (not pairs, "no blocks"), (len(p["markdown"]) < 200, "too short"), (not kinds["h2"], "no h2 heading"),
            (not kinds["p"], "no paragraph"), (kinds["li"] < p["n_li"], "list items lost"), (kinds["table"] < p["n_tables"], "tables lost"), (not p["article_text"], "no article text"),
            ("<script" in p["markdown"], "script text"), (any("�" in t for _, t in pairs), "undecoded characters"), (len(set(pairs)) < len(pairs), "repeated blocks"),
        ]
        assert r["problems"] == "; ".join(m for bad, m in checks if bad)


def tokens(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", text).casefold())


def visible(text: str) -> str:
    text = re.sub(r"<[^>]+>", " ", re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text))
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = text.replace(name, sign)
    return re.sub(r"`|\*\*|__", "", text)


def test_token_multiset_coverage(spark):
    want = {}
    for i, u, h in rows("select page_id, url, html from pages"):
        p = html.parse(u or "", h or "")
        raw, kept = Counter(tokens(p["article_text"])), Counter(tokens(visible(p["markdown"])))
        if raw:
            want[i] = (raw.total(), (raw & kept).total())
    assert {r["page_id"]: (r["raw_tokens"], r["shared"]) for r in collect(spark, "token_multiset_coverage")} == want


def test_context_selection(spark):
    def squeezed(t):
        return re.sub(r"[ \t\n\x0b\f\r]+", " ", t or "").strip(" ")

    docs, items = dict(rows("select doc_id, text from documents")), dict(rows("select item_id, text from benchmark"))
    pairs = [(q, d) for q, t in items.items() for d, x in docs.items() if len(squeezed(t)) >= 20 and len(squeezed(t).split(" ")) >= 4 and squeezed(t) in squeezed(x)]
    want = {}
    for q, d in pairs:
        terms = {t for t in re.findall(r"[A-Za-z0-9$]+", items[q].lower()) if len(t) >= 4 and t not in N.STOPWORDS}
        lines = redacted(docs[d]).split("\n")
        scored = [(-len(terms & set(re.findall(r"[A-Za-z0-9$]+", x.lower()))), i) for i, x in enumerate(lines)]
        best = sorted(x for x in scored if x[0] <= -2 and x[1] >= 20)[:30]
        text = "\n".join(dict.fromkeys(lines[i] for _, i in sorted(best, key=lambda x: x[1])))[:4000]
        want[q, d] = (len(text), sha(text))
    assert pairs and {(r["item_id"], r["doc_id"]): (r["chars"], r["context_sha256"]) for r in collect(spark, "context_selection")} == want


def test_notice_identify(spark):
    got = {r["notice_id"]: (r["status"], r["notice_code"], r["route"], r["confidence"]) for r in collect(spark, "notice_identify")}
    assert got == {
        1: ("identified", "CP503", "CP503", 0.99), 2: ("ambiguous", None, None, 0.99), 3: ("unidentified", None, None, 0.0), 4: ("identified", "LT11", "LT11 / Letter 1058", 0.99),
        5: ("identified", "CP12", "CP12 series", 0.96), 6: ("identified", "CP503", "CP503", 0.99), 7: ("unidentified", None, None, 0.0),
    }


def test_answer_flow(spark):
    from tessera.plans import grounding

    got = {r["qid"]: r.asDict() for r in collect(spark, "answer_flow")}
    docs: dict = {}
    for i, t, s in rows("select doc_id, text, source from documents order by doc_id"):
        if (t or "").strip(" "):
            docs.setdefault(s, (i, re.sub(r"[ \t\n\x0b\f\r]+", " ", t).strip(" ")[:360]))
    texts = {r["qid"]: r["text"] for r in grounding.flow_questions(spark, DATA).collect()}
    assert set(got) == set(texts) and len(got) > 10
    for qid, text in texts.items():
        m = re.search(r"(?i)\b(src[0-9]+)\b", text or "")
        code = m[1].lower() if m and len(text) <= 4000 else None
        q = " ".join((text or "").casefold().split())
        reason = next((name for name, ps in N.REFUSALS if all(re.search(p, q) for p in ps)), None)
        status = "too_long" if len(text or "") > 4000 else "clarify" if code is None else "refuse" if reason or code not in docs else "answer"
        assert (got[qid]["status"], got[qid]["code"], got[qid]["reason"]) == (status, code, reason), text
        assert got[qid]["answer"] == (docs[code][1] + " [C1]" if status == "answer" else None)


def test_chunk_tokens(spark):
    """All windows of 220 tokens, 40 of them shared, against ids from the library that made the file."""
    from tokenizers import Tokenizer

    from tessera.operators import tokenwindows

    library = Tokenizer.from_file(tokenwindows.default_path())
    got: dict = {}
    for r in collect(spark, "chunk_tokens_220_40"):
        got.setdefault(r["doc_id"], []).append((r["ordinal"], r["token_start"], r["token_end"], r["token_count"]))
    for i, t in rows("select doc_id, text from documents"):
        n = len(library.encode(t, add_special_tokens=False).ids) if t and t.strip() else 0
        spans = [(s, min(s + 220, n)) for s in range(0, max(n - 40, 1), 180)] if n else []
        assert [(a, b) for _, a, b, _ in sorted(got.get(i, []))] == spans
        assert all(c <= 220 and o == k for k, (o, _, _, c) in enumerate(sorted(got.get(i, []))))
