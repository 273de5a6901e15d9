"""Queries about evidence, claims, answers and their judgement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import notice as N
from tessera.functions import text as T
from tessera.operators import answer, ground

from . import corpus, notices
from .common import read, squeeze_sql
from .retrieval import DENSE_SQL, dense_topk_filtered


def evidence_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the evidence of each vector query (its top five as documents) is complete and in its language."""
    top = dense_topk_filtered(spark, sf_dir)
    docs = read(spark, sf_dir, "documents")
    queries = read(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"))
    lang = docs.select(F.col("doc_id").alias("q_doc"), F.col("lang").alias("q_lang"))
    d = docs.select(F.col("doc_id").alias("d"), "text", "lang", "source")
    rows = top.join(lang, F.col("qid") == F.col("q_doc"), "left").join(d, F.col("id") == F.col("d"), "left")
    ok = F.coalesce((F.trim("text") != "") & F.col("source").isNotNull() & (F.col("lang") == F.col("q_lang")), F.lit(False))
    return ground.sufficient(queries, rows, ok)


EVIDENCE_SQL = f"""
WITH {DENSE_SQL}, r AS (SELECT de.qid, coalesce(trim(d.text) <> '' AND d.source IS NOT NULL AND d.lang = q.lang, false) AS ok FROM de LEFT JOIN documents q ON q.doc_id = de.qid LEFT JOIN documents d ON d.doc_id = de.id)
SELECT e.vec_id AS qid, count(r.ok) AS n, coalesce(bool_and(r.ok) AND count(r.ok) > 0, false) AS sufficient FROM embeddings e LEFT JOIN r ON r.qid = e.vec_id WHERE e.vec_id % 100 = 0 GROUP BY e.vec_id
"""


def claim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draft claims: every benchmark item cites all documents that hold it; every third claim cites another document instead, every fifth quotes changed words."""
    found = corpus.quote_containment(spark, sf_dir).select("item_id", "doc_id")
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("i"), F.col("text").alias("passage"))
    j = found.join(items, F.col("item_id") == F.col("i"))
    cited = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id"))
    quote = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("changed "), "passage")).otherwise(F.col("passage"))
    return j.select(F.col("item_id").alias("answer_id"), F.col("doc_id").alias("pos"), T.preview(F.col("passage"), 40).alias("text"), cited.alias("cited_id"), quote.alias("quote"))


CLAIMS_SQL = f"""
found AS ({corpus.QUOTE_SQL.strip()}),
claims AS (SELECT f.item_id AS answer_id, f.doc_id AS pos, substr({squeeze_sql("b.text")}, 1, 40) AS text, CASE WHEN f.doc_id % 3 = 0 THEN f.doc_id + 1 ELSE f.doc_id END AS cited_id,
  CASE WHEN f.doc_id % 5 = 0 THEN 'changed ' || b.text ELSE b.text END AS quote FROM found f JOIN benchmark b USING (item_id)),
ck AS (SELECT c.*, coalesce(e.doc_id IS NOT NULL AND contains({squeeze_sql("d.text")}, {squeeze_sql("c.quote")}) AND length({squeeze_sql("c.quote")}) >= 20 AND len(string_split({squeeze_sql("c.quote")}, ' ')) >= 4, false) AS ok
  FROM claims c LEFT JOIN found e ON e.item_id = c.answer_id AND e.doc_id = c.cited_id LEFT JOIN documents d ON d.doc_id = e.doc_id)
"""


def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpus.quote_containment(spark, sf_dir).select(F.col("item_id").alias("answer_id"), F.col("doc_id").alias("chunk_id"))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), F.col("text").alias("body"))
    return found.join(docs, F.col("chunk_id") == F.col("d")).drop("d")


def grounded_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground.bind(claim_rows(spark, sf_dir), evidence_rows(spark, sf_dir))


GROUNDED_SQL = f"""
WITH {CLAIMS_SQL}, u AS (SELECT *, min(pos) OVER (PARTITION BY answer_id, cited_id) AS fu FROM ck), n AS (SELECT *, dense_rank() OVER (PARTITION BY answer_id ORDER BY fu) AS k FROM u)
SELECT answer_id, CASE WHEN bool_and(ok) THEN 'answered' ELSE 'refused' END AS status, CASE WHEN bool_and(ok) THEN string_agg(text || ' [C' || k || ']', ' ' ORDER BY pos) END AS answer,
  CASE WHEN bool_and(ok) THEN array_to_string(list_transform(list_sort(list_distinct(list({{'k': k, 'c': cited_id}}))), lambda x: 'C' || x.k || '=' || x.c), ',') END AS citations, count(*) AS n_claims FROM n GROUP BY answer_id
"""


def claim_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations resolved hop by hop: retrieved for the answer, known as a document, judged by label."""
    claims = claim_rows(spark, sf_dir).select("answer_id", "pos", "cited_id")
    ev = evidence_rows(spark, sf_dir).select(F.col("answer_id").alias("e_answer"), "chunk_id")
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), "source")
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("l"), "quality")
    j = claims.join(ev, (F.col("answer_id") == F.col("e_answer")) & (F.col("cited_id") == F.col("chunk_id")), "left").join(docs, F.col("cited_id") == F.col("d"), "left").join(labels, F.col("cited_id") == F.col("l"), "left")
    return j.select("answer_id", "pos", "cited_id", F.col("chunk_id").isNotNull().alias("retrieved"), F.col("d").isNotNull().alias("known"), "source", "quality")


PROVENANCE_SQL = f"WITH {CLAIMS_SQL} SELECT c.answer_id, c.pos, c.cited_id, f.doc_id IS NOT NULL AS retrieved, d.doc_id IS NOT NULL AS known, d.source, l.quality FROM claims c LEFT JOIN found f ON f.item_id = c.answer_id AND f.doc_id = c.cited_id LEFT JOIN documents d ON d.doc_id = c.cited_id LEFT JOIN labels l ON l.doc_id = c.cited_id"


def faithfulness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source: the share of judged documents of good quality, null where a document is not judged."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("l"), "quality")
    j = docs.join(labels, F.col("doc_id") == F.col("l"), "left")
    by = j.withColumn("part", F.concat_ws("/", "source", "lang", F.when(F.col("l").isNull(), "unjudged").otherwise("judged")))
    return ground.faithfulness(by, "part", F.col("quality") == 1, F.col("quality").isNotNull())


FAITH_SQL = """
WITH j AS (SELECT concat_ws('/', d.source, d.lang, CASE WHEN l.doc_id IS NULL THEN 'unjudged' ELSE 'judged' END) AS part, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT part, count(*) AS n, count(quality) AS judged, count_if(quality = 1) AS supported, round(CASE WHEN count(quality) = count(*) THEN count_if(quality = 1)::DOUBLE / count(*) END, 6) AS faithfulness FROM j GROUP BY part
"""


def refusal_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in which every user turn is outside of policy or the assistant says nothing after it: all conditions per question, then the rate."""
    c = read(spark, sf_dir, "conversations").withColumn("reason", N.refusal_reason(F.col("text")))
    g = c.groupBy("conv_id").agg(F.bool_and(F.when(F.col("role") == "user", F.col("reason").isNotNull())).alias("policy"), F.count_if(F.col("role") == "assistant").alias("replies"), F.count_if(F.col("role") == "user").alias("asked"))
    row = F.coalesce(F.col("policy"), F.lit(False)) | (F.col("replies") < F.col("asked"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if(row).alias("refused"), F.round(F.avg(row.cast("int")), 6).alias("rate"), F.sum("replies").alias("replies"))


REFUSAL_SQL = f"""
WITH n AS (SELECT conv_id, role, {squeeze_sql("replace(lower(text), 'ß', 'ss')")} AS q FROM conversations),
g AS (SELECT conv_id, bool_and(CASE WHEN role = 'user' THEN ({notices._case()}) IS NOT NULL END) AS policy, count_if(role = 'assistant') AS replies, count_if(role = 'user') AS asked FROM n GROUP BY conv_id)
SELECT count(*) AS n, count_if(coalesce(policy, false) OR replies < asked) AS refused, round(avg((coalesce(policy, false) OR replies < asked)::INT), 6) AS rate, sum(replies)::BIGINT AS replies FROM g
"""


def evaluator_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of eight documents judged again: documents without a label, and the labelled ones as they were."""
    docs, labels = read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels")
    again = docs.join(labels, "doc_id", "left_anti").select("doc_id", F.lit(None).cast("int").alias("quality"), F.lit("again").alias("origin"))
    out = labels.select("doc_id", F.col("quality").cast("int"), F.lit("kept").alias("origin")).unionByName(again)
    return out.withColumn("batch", F.floor(F.col("doc_id") / 8))


def vector_upsert_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after an upsert of the even ids with label + 100, by label."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    batch = e.where("vec_id % 2 = 0").withColumn("label", F.col("label") + 100)
    return ground.upsert(e, batch, "vec_id").groupBy("label").agg(F.count(F.lit(1)).alias("vectors"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))


GOLD = [
    ("A01", "A", False, 0, "en"), ("A02", "A", True, 1, "en"), ("B01", "B", False, 2, "fr"), ("D07", "D", False, 5, "xx"), ("E01", "E", True, None, None), ("C03", "C", False, 99999999, "en"),
]


def question_scope_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions in scope (A-D, not to be refused) with whether their expected document exists and has the expected language."""
    q = spark.createDataFrame(GOLD, "qid string, category string, should_refuse boolean, expected_doc long, expected_lang string")
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), "lang")
    j = q.where(F.substring("qid", 1, 1).isin("A", "B", "C", "D") & ~F.col("should_refuse")).join(docs, F.col("expected_doc") == F.col("d"), "left")
    return j.select("qid", "category", F.col("d").isNotNull().alias("known"), F.coalesce(F.col("lang") == F.col("expected_lang"), F.lit(False)).alias("language_matches"))


def _gold_sql() -> str:
    def v(x) -> str:
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else f"'{x}'"

    return ", ".join("(" + ", ".join(map(v, r)) + ")" for r in GOLD)


GOLD_SQL = f"""
WITH q(qid, category, should_refuse, expected_doc, expected_lang) AS (VALUES {_gold_sql()})
SELECT qid, category, d.doc_id IS NOT NULL AS known, coalesce(d.lang = expected_lang, false) AS language_matches FROM q LEFT JOIN documents d ON d.doc_id = q.expected_doc WHERE substr(qid, 1, 1) IN ('A','B','C','D') AND NOT should_refuse
"""


def retrieval_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieved rows (top five of the vector queries) against the registry of documents, and the number eligible per source."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    eligible = docs.groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("eligible"))
    meta = docs.select(F.col("doc_id").alias("d"), "lang", F.when(F.col("doc_id") % 11 == 0, "changed").otherwise(F.col("source")).alias("source"))
    rows = dense_topk_filtered(spark, sf_dir).select("qid", F.col("id").alias("doc_id"), "rank").join(meta, F.col("doc_id") == F.col("d"), "left").drop("d")
    out = ground.verify(rows, docs, "doc_id", ["lang", "source"])
    return out.join(eligible, F.col("source") == F.col("s"), "left").select("qid", "doc_id", "rank", "known", "verified", F.coalesce("eligible", F.lit(0)).alias("eligible"))


VERIFY_SQL = f"""
WITH {DENSE_SQL}, el AS (SELECT source, count(*) AS n FROM documents GROUP BY 1)
SELECT de.qid, de.id AS doc_id, de.rank, d.doc_id IS NOT NULL AS known, d.doc_id IS NOT NULL AND (d.doc_id % 11 <> 0 OR d.source = 'changed') AS verified, CASE WHEN d.doc_id % 11 = 0 THEN 0 ELSE coalesce(el.n, 0) END AS eligible
FROM de LEFT JOIN documents d ON d.doc_id = de.id LEFT JOIN el ON el.source = d.source
"""


def flow_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All user turns, one for each of them that names a source by its turn, and one that is too long."""
    turns = read(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("qid"), "text", "turn")
    named = turns.select(F.concat("qid", F.lit("-src")).alias("qid"), F.concat(F.lit("From SRC"), F.col("turn").cast("string"), F.lit(": "), "text").alias("text"))
    long = spark.range(1).select(F.lit("long").alias("qid"), F.concat(F.lit("src1 "), F.repeat(F.lit("x"), 4000)).alias("text"))
    return turns.select("qid", "text").unionByName(named).unionByName(long)


def answer_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question through the answer states: too long, clarify, refuse or answer, with its evidence."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("code"))
    return answer.flow(flow_questions(spark, sf_dir), docs)


QUERIES = {
    f.__name__: f
    for f in (
        evidence_sufficiency, claim_provenance, grounded_answer, faithfulness_score, refusal_score, evaluator_recovery, vector_upsert_antijoin, question_scope_ground_truth, retrieval_verify, answer_flow,
    )
}
SQL = {
    "evidence_sufficiency": EVIDENCE_SQL,
    "claim_provenance": PROVENANCE_SQL,
    "grounded_answer": GROUNDED_SQL,
    "faithfulness_score": FAITH_SQL,
    "refusal_score": REFUSAL_SQL,
    "evaluator_recovery": "SELECT doc_id, quality::INT AS quality, 'kept' AS origin, doc_id // 8 AS batch FROM labels UNION ALL SELECT doc_id, NULL, 'again', doc_id // 8 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "vector_upsert_antijoin": "WITH t AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN label + 100 ELSE label END AS label FROM embeddings) SELECT label, count(*) AS vectors, min(vec_id) AS first_id, max(vec_id) AS last_id FROM t GROUP BY label",
    "question_scope_ground_truth": GOLD_SQL,
    "retrieval_verify": VERIFY_SQL,
}
