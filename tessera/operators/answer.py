"""The answer states of a question: identify, then clarify or retrieve, then refuse or answer.

All questions run at once: each state is a column, and a branch is a condition. Model calls
are interfaces (``providers``); the offline generator quotes its best evidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import notice as N
from tessera.functions import text as T

MAX_QUESTION = 4000


def flow(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """qid, status, code, reason, evidence_id, answer of questions (qid, text); docs: doc_id, text, code.

    A question of more than MAX_QUESTION characters is not read (too_long). One without a
    source code in it asks back (clarify), also if policy would refuse it; a policy rule or
    missing evidence refuses; else the smallest document of the source is quoted with its
    first 360 characters.
    """
    code = F.nullif(F.lower(F.regexp_extract("text", r"(?i)\b(src[0-9]+)\b", 1)), F.lit(""))
    long = F.coalesce(F.length("text") > MAX_QUESTION, F.lit(False))
    q = questions.select("qid", F.when(~long, code).alias("code"), N.refusal_reason(F.col("text")).alias("reason"), long.alias("long"))
    w = W.partitionBy("code").orderBy("doc_id")
    first = docs.where(F.trim("text") != "").select("code", "doc_id", T.preview(F.col("text"), 360).alias("quote")).withColumn("r", F.row_number().over(w)).where("r = 1")
    j = q.join(first.select(F.col("code").alias("d_code"), "doc_id", "quote"), F.col("code") == F.col("d_code"), "left")
    status = F.when(F.col("long"), "too_long").when(F.col("code").isNull(), "clarify").when(F.col("reason").isNotNull() | F.col("doc_id").isNull(), "refuse").otherwise("answer")
    j = j.withColumn("status", status)
    given = F.col("status") == "answer"
    return j.select("qid", "status", "code", "reason", F.when(given, F.col("doc_id")).alias("evidence_id"), F.when(given, F.concat("quote", F.lit(" [C1]"))).alias("answer"))
