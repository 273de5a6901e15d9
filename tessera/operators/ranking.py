"""Fusion, rank metrics, comparisons of systems and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K, TOP, MISS = 60, 5, 6


def rrf(rankings: list[DataFrame], top: int = TOP) -> DataFrame:
    """qid, id, score, rank by reciprocal-rank fusion of rankings (qid, id, rank); an absent side adds nothing."""
    u = rankings[0].select("qid", "id", "rank")
    for r in rankings[1:]:
        u = u.unionByName(r.select("qid", "id", "rank"))
    s = u.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 12).alias("score"))
    w = W.partitionBy("qid").orderBy(F.desc("score"), "id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def first_relevant(ranked: DataFrame, queries: DataFrame, relevant: Column) -> DataFrame:
    """qid and first_rank (null: none among the best) for every query; relevant: a condition on ranked rows joined with ``queries`` (qid, ...)."""
    q = queries.withColumnRenamed("qid", "q")
    j = q.join(ranked, F.col("q") == F.col("qid"), "left")
    return j.groupBy("q").agg(F.min(F.when(relevant, F.col("rank"))).alias("first_rank")).withColumnRenamed("q", "qid")


def metric_columns(first_rank: Column) -> list[Column]:
    """n, correct_at_1, precision_at_1, mrr, hit_at_5."""
    rr = F.when(first_rank.isNull(), 0.0).otherwise(1.0 / first_rank)
    return [
        F.count(F.lit(1)).alias("n"), F.count_if(first_rank == 1).alias("correct_at_1"), F.round(F.avg(F.when(first_rank == 1, 1.0).otherwise(0.0)), 6).alias("precision_at_1"),
        F.round(F.avg(rr), 6).alias("mrr"), F.count_if(first_rank <= TOP).alias("hits_at_5"),
    ]


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two systems by question: ranks (a miss counts as 6), the change, and the class by precision at 1 alone."""
    x, y = a.select("qid", F.col("first_rank").alias("rank_a")), b.select("qid", F.col("first_rank").alias("rank_b"))
    one_a, one_b = F.coalesce(F.col("rank_a") == 1, F.lit(False)), F.coalesce(F.col("rank_b") == 1, F.lit(False))
    kind = F.when(one_b & ~one_a, "IMPROVED").when(one_a & ~one_b, "REGRESSED").otherwise("UNCHANGED")
    change = F.coalesce("rank_a", F.lit(MISS)) - F.coalesce("rank_b", F.lit(MISS))
    return x.join(y, "qid").select("qid", "rank_a", "rank_b", change.alias("rank_change"), kind.alias("classification"))


def margin(scored: DataFrame, correct: Column) -> DataFrame:
    """Per query the best correct score minus the best incorrect one; null if either is missing."""
    return scored.groupBy("qid").agg((F.max(F.when(correct, F.col("score"))) - F.max(F.when(~correct, F.col("score")))).alias("margin"))


def hardest(rows: DataFrame, n: int = 5) -> DataFrame:
    """The n hardest queries (qid, first_rank, margin): misses first, then the lower rank, then the smaller margin (null last), then qid."""
    return rows.orderBy(F.col("first_rank").isNull().desc(), F.coalesce("first_rank", F.lit(MISS)).desc(), F.col("margin").asc_nulls_last(), "qid").limit(n)


def select_model(models: DataFrame) -> DataFrame:
    """The eligible model with the lowest p95, then the highest structured rate, the lowest generation p95 (null last), the first in order."""
    return models.where("eligible").orderBy("p95", F.desc("structured_rate"), F.col("generation_p95").asc_nulls_last(), "position").limit(1)


def decide(runs: DataFrame, base: str, p95: DataFrame, gain: float = 0.05, most_p95: float = 2.0) -> DataFrame:
    """Whether a variant may replace the base system, and whether it does (the least complex that may).

    runs: variant, complexity, qid, ok; p95: place (the complexity), p95. A variant may if it
    gains enough, or mends the base's first failing question without failing one that the base
    answers, within the latency limit.
    """
    known = runs.where(F.col("variant") == base).select(F.col("qid").alias("b"), F.col("ok").alias("base_ok"))
    failing = known.agg(F.min(F.when(~F.col("base_ok"), F.col("b"))).alias("failing"))
    j = runs.where(F.col("variant") != base).join(known, F.col("qid") == F.col("b")).crossJoin(F.broadcast(failing))  # one row
    g = j.groupBy("variant", "complexity").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("correct"), F.count_if("base_ok").alias("base_correct"),
        F.count_if(F.col("base_ok") & ~F.col("ok")).alias("regressions"), F.coalesce(F.bool_or(F.col("ok") & (F.col("qid") == F.col("failing"))), F.lit(False)).alias("mends"),
    )
    v = g.join(p95, F.col("place") == F.col("complexity"))
    better = F.round((F.col("correct") - F.col("base_correct")) / F.col("n"), 9) >= gain
    v = v.withColumn("eligible", (better | (F.col("mends") & (F.col("regressions") == 0))) & (F.col("p95") <= most_p95))
    best = F.min(F.when(F.col("eligible"), F.col("complexity"))).over(W.partitionBy())  # a row a variant
    chosen = F.coalesce(F.col("eligible") & (F.col("complexity") == best), F.lit(False))
    return v.select("variant", "complexity", F.round(F.col("correct") / F.col("n"), 6).alias("precision_at_1"), F.round(F.col("base_correct") / F.col("n"), 6).alias(f"{base}_precision"), "regressions", "p95", "eligible", chosen.alias("chosen"))
