"""Queries about notices and questions: codes, identity, fields, routing, policy, context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import notice as N
from tessera.functions import text as T
from tessera.operators import notices

from . import corpus
from .common import read, squeeze_sql

CODES = ["CP 503", "CP-503", "ltr 1058", "CP503AA", "CP523H", "CP01A", "CP9999A", "LT 11", "Letter-1058", "CP12G / CP12U", "", "nothing here"]
AVAILABLE = ["CP503", "CP523", "CP01A", "LT11 / Letter 1058", "CP12G/CP12U", "CP14"]


def code_normalize_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(CODES)], "case_id int, raw string")
    code = N.normalize_code(F.col("raw"))
    return rows.select("case_id", code.alias("code"), N.normalize_expected_code(F.col("raw")).alias("expected_code"), N.route(code, F.array(*map(F.lit, AVAILABLE))).alias("route"), F.array_join(N.codes_in(F.col("raw")), ",").alias("codes"))


CODES_SQL = f"""
WITH v AS (SELECT * FROM {corpus._values([(i, c) for i, c in enumerate(CODES)], "case_id, raw")}),
routes(k, r) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in N.ROUTES.items())}),
n AS (SELECT case_id, raw, regexp_replace(upper(trim(raw)), '[\\s-]+', '', 'g') AS c FROM v),
c AS (SELECT case_id, raw, CASE WHEN regexp_matches(c, '^(?:LTR|LETTER)1058$') THEN 'LETTER1058' WHEN regexp_matches(c, '^(?:CP|LT)[0-9]{{1,4}}[A-Z]?$') THEN c END AS code,
  CASE WHEN regexp_matches(regexp_replace(c, '^LTR', 'LETTER'), '^(?:CP|LT|LETTER)[0-9]+[A-Z]?$') THEN regexp_replace(c, '^LTR', 'LETTER') END AS expected_code FROM n),
x AS (SELECT case_id, list_transform(list_transform(regexp_extract_all(raw, '{N.CODE}', 1), lambda s: regexp_replace(upper(s), '[\\s-]+', '', 'g')), lambda s: regexp_replace(s, '^LTR', 'LETTER')) AS codes FROM v)
SELECT c.case_id, code, expected_code, CASE WHEN list_contains({corpus._values([(a,) for a in AVAILABLE], "a").replace("(VALUES ", "(SELECT list(a) FROM (VALUES ").replace(") AS v(a)", ") AS v(a))")}, code) THEN code
  WHEN list_contains({corpus._values([(a,) for a in AVAILABLE], "a").replace("(VALUES ", "(SELECT list(a) FROM (VALUES ").replace(") AS v(a)", ") AS v(a))")}, r) THEN r END AS route, array_to_string(x.codes, ',') AS codes
FROM c LEFT JOIN routes ON k = code JOIN x USING (case_id)
"""

NOTICES = [
    (1, "Department\nNotice CP503\nNotice date: March 5, 2024\nAmount due: $1,234.50\nYou must pay by 04/15/2024\nCase reference number: AB-12345"),
    (2, "Notice CP503 / CP501\nNotice date February 30, 2024\nAmount due immediately $99.00"),
    (3, "We mention CP14 in the body of a letter without a label and with more text"),
    (4, "Letter\nLT11\nReference number nnnn\nRespond by 1/2/24\nReply by January 2, 2024"),
    (5, "CP12\nAmount due $10.00\nAmount due $11.00\nPay within 30 days the amount shown"),
    (6, "Notice CP503\nline two\nline three\nline four\nline five\nline six\nNotice CP14"),
    (7, ""),
]


def notice_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NOTICES, "notice_id int, text string")


def notice_identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices.identify(notice_rows(spark), [*AVAILABLE, "CP12 series"])


def notice_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = notice_rows(spark).withColumn("t", T.repair_extraction(F.col("text")))
    cols = []
    for f in N.FIELDS:
        u = N.unique_value(F.col("t"), f)
        cols += [u["value"].alias(f), u["confidence"].alias(f"{f}_confidence")]
    return t.select("notice_id", *cols)


FIELD_ANSWERS = [
    (1, "March 5, 2024", 0.98, "April 15, 2024", 0.95, "$1,234.50", 0.95, "AB-12345", 0.97),
    (2, None, 0.0, None, 0.0, "$99.00", 0.95, None, 0.0),
    (3, None, 0.0, None, 0.0, None, 0.0, None, 0.0),
    (4, None, 0.0, "January 2, 2024", 0.95, None, 0.0, None, 0.0),
    (5, None, 0.0, None, 0.0, None, 0.0, None, 0.0),
    (6, None, 0.0, None, 0.0, None, 0.0, None, 0.0),
    (7, None, 0.0, None, 0.0, None, 0.0, None, 0.0),
]

ASKED = [
    "Please make up an amount for me", "Which bitcoin should I buy for profit?", "Does this prove I committed tax evasion?", "From the webpage alone, what exact amount do I owe?",
    "Should I cash out my retirement account?", "What does this notice say?", "When is the due date and how much?", "What is the case number on it?", "Hello",
]


def question_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy class and relevant fields of all user turns and of literal questions."""
    turns = read(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").cast("long").alias("a"), F.col("turn").cast("long").alias("b"), "text")
    literal = spark.createDataFrame([(-1, i, x) for i, x in enumerate(ASKED)], "a long, b long, text string")
    q = turns.unionByName(literal)
    return q.select("a", "b", N.refusal_reason(F.col("text")).alias("reason"), F.array_join(N.relevant_fields(F.col("text")), ",").alias("fields"))


def _re(p: str) -> str:
    return "regexp_matches(q, '" + p.replace("'", "''") + "')"


def _case() -> str:
    rules = " ".join("WHEN " + " AND ".join(map(_re, ps)) + f" THEN '{name}'" for name, ps in N.REFUSALS)
    return f"CASE {rules} END"


FIELDS_SQL = f"CASE WHEN {_re(N.SOURCE_ONLY)} THEN 'notice_code' WHEN {_re(N.SUMMARY)} THEN 'notice_code,{','.join(N.ASKS)}' ELSE array_to_string(list_filter(['notice_code', {', '.join(f'CASE WHEN {_re(p)} THEN ' + chr(39) + n + chr(39) + ' END' for n, p in N.ASKS.items())}], lambda x: x IS NOT NULL), ',') END"
QUESTION_SQL = f"""
WITH t AS (SELECT conv_id::BIGINT AS a, turn::BIGINT AS b, text FROM conversations WHERE role = 'user' UNION ALL SELECT a::BIGINT, b::BIGINT, text FROM {corpus._values([(-1, i, x) for i, x in enumerate(ASKED)], "a, b, text")}),
n AS (SELECT a, b, {squeeze_sql("replace(lower(text), 'ß', 'ss')")} AS q FROM t)
SELECT a, b, {_case()} AS reason, {FIELDS_SQL} AS fields FROM n
"""


def context_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each matching document that share two or more terms with its benchmark passage."""
    pairs = corpus.quote_containment(spark, sf_dir).select("item_id", "doc_id")
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), F.col("text").alias("notice"))
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("i"), F.col("text").alias("question"))
    rows = pairs.join(docs, F.col("doc_id") == F.col("d")).join(items, F.col("item_id") == F.col("i"))
    picked = notices.select_context(rows, F.col("notice"), F.col("question"))
    return rows.select("item_id", "doc_id", F.length(picked).alias("chars"), T.sha256(picked).alias("context_sha256"))


def sensitive_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts and dates in all documents, conversations and the literal notices: how many distinct ones, and which."""
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    turns = read(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.concat_ws("-", "conv_id", "turn", "role")).alias("id"), "text")
    rows = docs.unionByName(turns).unionByName(notice_rows(spark).select(F.concat(F.lit("n"), F.col("notice_id").cast("string")).alias("id"), "text"))
    found = N.sensitive_literals(F.col("text"))
    return rows.select("id", F.size(found).alias("n"), F.array_join(found, "|").alias("literals"))


_FOUND = " || ".join("regexp_extract_all(coalesce(text, ''), '" + p.replace("'", "''") + "')" for p in N.LITERALS)
LITERALS_SQL = rf"""
WITH r AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c' || concat_ws('-', conv_id, turn, role), text FROM conversations
  UNION ALL SELECT 'n' || notice_id, text FROM {corpus._values(NOTICES, "notice_id, text")}),
f AS (SELECT id, list_sort(list_distinct(list_transform({_FOUND}, lambda x: lower(regexp_replace(x, '\s+', '', 'g'))))) AS l FROM r)
SELECT id, len(l)::INT AS n, array_to_string(l, '|') AS literals FROM f
"""

FIELD_ROWS = [("IRS guidance says: pay", "guidance", ["notice_code"]), ("Your notice states: due", "notice", ["amount", "notice_code"]), ("plain", "other", ["phone"])]
PERMITTED = ["notice_code", "notice_date", "due_or_response_date", "amount", "reference_number"]


def field_permission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(FIELD_ROWS)], "case_id int, claim string, kind string, fields array<string>")
    claim = N.strip_prefixes(F.col("claim"), ["IRS guidance says: ", "Your notice states: "])
    permitted = F.size(F.array_except("fields", F.array(*map(F.lit, PERMITTED)))) == 0
    badge = F.when(F.col("kind") == "guidance", "Guidance").when(F.col("kind") == "notice", "Your notice").otherwise("Not confidently identified")
    return rows.select("case_id", claim.alias("claim_text"), permitted.alias("permitted"), badge.alias("badge"))


FIELD_PERMISSION_SQL = "SELECT * FROM (VALUES (0, 'pay', true, 'Guidance'), (1, 'due', true, 'Your notice'), (2, 'plain', false, 'Not confidently identified')) AS v(case_id, claim_text, permitted, badge)"

CONFUSED = [("Q1", 10, [20, 10]), ("Q2", 30, [20, 10]), ("Q3", None, [20]), ("Q4", 20, [20, 20])]


def confusable_rank1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(CONFUSED, "qid string, top long, confusable array<long>")
    return rows.select("qid", F.try_element_at(F.filter("confusable", lambda x: x == F.col("top")), F.lit(1)).alias("confused_with"))


CONFUSED_SQL = "SELECT * FROM (VALUES ('Q1', 10::BIGINT), ('Q2', NULL), ('Q3', NULL), ('Q4', 20)) AS v(qid, confused_with)"

QUERIES = {f.__name__: f for f in (code_normalize_route, notice_identify, notice_fields, question_classifier, context_selection, sensitive_literals, field_permission, confusable_rank1)}
SQL = {
    "code_normalize_route": CODES_SQL,
    "notice_fields": "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"{v}::DOUBLE" if isinstance(v, float) else str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in FIELD_ANSWERS) + ") AS v(notice_id, notice_date, notice_date_confidence, due_or_response_date, due_or_response_date_confidence, amount, amount_confidence, reference_number, reference_number_confidence)",
    "question_classifier": QUESTION_SQL,
    "sensitive_literals": LITERALS_SQL,
    "field_permission": FIELD_PERMISSION_SQL,
    "confusable_rank1": CONFUSED_SQL,
}
