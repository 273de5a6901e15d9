"""Evidence, claims and grounded answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T


def sufficient(queries: DataFrame, retrieved: DataFrame, ok: Column) -> DataFrame:
    """qid, n, sufficient: whether there is evidence and every retrieved row (qid, ...) is complete; there is no score cut-off."""
    g = retrieved.groupBy(F.col("qid").alias("r_qid")).agg(F.count(F.lit(1)).alias("n"), F.bool_and(ok).alias("all_ok"))
    j = queries.select("qid").join(g, F.col("qid") == F.col("r_qid"), "left")
    return j.select("qid", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("all_ok") & (F.col("n") > 0), F.lit(False)).alias("sufficient"))


def verify(rows: DataFrame, registry: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with ``known`` (the id is registered) and ``verified`` (all columns equal the registered ones, null-safe)."""
    r = registry.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in columns))
    j = rows.join(r, F.col(key) == F.col("_k"), "left")
    same = F.col("_k").isNotNull()
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return j.withColumn("known", F.col("_k").isNotNull()).withColumn("verified", same).drop("_k", *(f"_{c}" for c in columns))


def bind(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Check draft claims against evidence and build answers.

    claims: answer_id, pos, text, cited_id, quote. evidence: answer_id, chunk_id, body (what was
    retrieved). A claim holds if its citation was retrieved and its quote stands in it; one
    that does not refuses the whole answer. Returns answer_id, status, answer, citations,
    n_claims. Citations are numbered by first use.
    """
    e = evidence.select(F.col("answer_id").alias("e_answer"), "chunk_id", "body")
    j = claims.join(e, (F.col("answer_id") == F.col("e_answer")) & (F.col("cited_id") == F.col("chunk_id")), "left")
    ok = F.coalesce(F.col("chunk_id").isNotNull() & T.contains_literally(F.col("body"), F.col("quote")), F.lit(False))
    checked = j.select("answer_id", "pos", "text", "cited_id", ok.alias("ok"))
    first = F.min("pos").over(W.partitionBy("answer_id", "cited_id"))
    numbered = checked.withColumn("first_use", first)
    numbered = numbered.withColumn("number", F.dense_rank().over(W.partitionBy("answer_id").orderBy("first_use")))
    g = numbered.groupBy("answer_id").agg(F.bool_and("ok").alias("all_ok"), F.count(F.lit(1)).alias("n_claims"), F.sort_array(F.collect_list(F.struct("pos", "text", "number", "cited_id"))).alias("c"))
    answer = F.array_join(F.transform("c", lambda x: F.concat(x["text"], F.lit(" [C"), x["number"].cast("string"), F.lit("]"))), " ")
    cited = F.array_join(F.array_distinct(F.transform("c", lambda x: F.concat(F.lit("C"), x["number"].cast("string"), F.lit("="), x["cited_id"].cast("string")))), ",")
    return g.select("answer_id", F.when(F.col("all_ok"), "answered").otherwise("refused").alias("status"), F.when(F.col("all_ok"), answer).alias("answer"), F.when(F.col("all_ok"), cited).alias("citations"), "n_claims")


def faithfulness(claims: DataFrame, group: str, supported: Column, judged: Column) -> DataFrame:
    """Share of supported claims by group; null unless there are claims and all are judged."""
    g = claims.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(judged).alias("judged"), F.count_if(judged & supported).alias("supported"))
    return g.withColumn("faithfulness", F.round(F.when(F.col("judged") == F.col("n"), F.col("supported") / F.col("n")), 6))


def upsert(existing: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The table after writing a batch: rows of the batch replace rows with their key."""
    return existing.join(batch.select(key), key, "left_anti").unionByName(batch.select(existing.columns))
