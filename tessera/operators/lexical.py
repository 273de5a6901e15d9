"""BM25 over a corpus with an exact filter key, scoring every document that shares a term with a query.

``rank`` takes the tokenised corpus (``lengths``). ``search`` takes the texts and reads them once: a document's
terms are counted in its row, so nothing is shuffled, and only terms that a query has are written. ``index`` has a
stored index that gives the same ranking, for corpora that are searched again and again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources import tables

K1, B, TOP = 1.5, 0.75, 5


def lengths(docs: DataFrame) -> DataFrame:
    """id, key, tokens, n of rows (id, key, text)."""
    return docs.select("id", "key", T.search_tokens(F.col("text")).alias("tokens")).withColumn("n", F.size("tokens"))


def counted(docs: DataFrame) -> DataFrame:
    """id, key, tokens (distinct, sorted), counts, n of rows (id, key, text): runs of equal terms in the sorted tokens. Columns, as lambdas work out what is in them for each element."""
    lens = lengths(docs).withColumn("sorted", F.sort_array("tokens")).drop("tokens")
    starts = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (i == 0) | (F.get("sorted", i) != F.get("sorted", i - 1)))
    lens = lens.withColumn("starts", F.when(F.col("n") > 0, starts).otherwise(F.array().cast("array<int>")))
    counts = F.transform("starts", lambda a, k: F.coalesce(F.get("starts", k + 1), F.col("n")) - a)
    return lens.select("id", "key", F.transform("starts", lambda a: F.get("sorted", a)).alias("tokens"), counts.alias("counts"), "n")


def document_frequencies(docs: DataFrame) -> DataFrame:
    """term, df of rows (id, key, text); counts of a term are summed up before the shuffle."""
    terms = docs.select(F.explode(F.array_distinct(T.search_tokens(F.col("text")))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(lens: DataFrame) -> DataFrame:
    """One row: the number of documents and their mean length."""
    return lens.agg(F.count(F.lit(1)).alias("n_docs"), (F.sum("n") / F.count(F.lit(1))).alias("avgdl"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.ln(1 + (n_docs - df + 0.5) / (df + 0.5))


def term_stats(terms: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, idf of a corpus from its terms (term, df) and its one row of ``stats``."""
    return terms.crossJoin(F.broadcast(stats)).select("term", "df", F.round(idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


def scores(lens: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, id, score of documents that share a term and the key with a query (qid, key, text).

    Statistics are of the whole corpus, scoring is filtered. Only terms that some query
    has are counted; a query's repeated terms count repeatedly.
    """
    q = queries.select("qid", F.col("key").alias("q_key"), F.explode(T.search_tokens(F.col("text"))).alias("term")).groupBy("qid", "q_key", "term").agg(F.count(F.lit(1)).alias("qf"))
    terms = q.select("term").distinct()
    each = lens.select("id", "key", "n", F.explode("tokens").alias("term"))
    tf = each.join(terms, "term", "left_semi").groupBy("term", "id", "key", "n").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy(F.col("term").alias("df_term")).agg(F.count(F.lit(1)).alias("df"))
    tf = tf.withColumnRenamed("term", "tf_term")
    m = q.join(tf, (F.col("term") == F.col("tf_term")) & (F.col("q_key") == F.col("key"))).join(df, F.col("term") == F.col("df_term")).crossJoin(F.broadcast(corpus_stats(lens)))
    norm = K1 * (1 - B + B * F.col("n") / F.col("avgdl"))
    part = F.col("qf") * idf(F.col("n_docs"), F.col("df")) * (F.col("tf") * (K1 + 1) / (F.col("tf") + norm))
    return m.groupBy("qid", "id").agg(F.sum(part).alias("score"))


def first_ids(lens: DataFrame, top: int) -> DataFrame:
    """k, id: the least ``top`` ids of each key. Parts of a key find their own before they are compared, so no key is one task."""
    d = lens.select("key", "id", F.pmod(F.xxhash64("id"), F.lit(1024)).alias("part"))
    for by in (["key", "part"], ["key"]):
        d = d.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy("id"))).where(F.col("r") <= top)
    return d.select(F.col("key").alias("k"), "id")


def rank(lens: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """qid, id, score, rank: the best ``top`` documents of each query's key; score desc, id asc, zero scores kept.

    A document without a common term can only be among the best if it is among the first
    ``top`` ids of its key, so no more zeros than these are looked at.
    """
    return ranked(scores(lens, queries), lens, queries, top)


def ranked(s: DataFrame, lens: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """The best ``top`` of scores (qid, id, score) and of the zeros that can be among them."""
    zeros = queries.select("qid", "key").join(first_ids(lens, top), F.col("key") == F.col("k")).select("qid", "id", F.lit(0.0).alias("score"))
    both = s.unionByName(zeros).groupBy("qid", "id").agg(F.max("score").alias("score"))
    r = F.row_number().over(W.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "id"))
    return both.withColumn("rank", r).where(F.col("rank") <= top)


def asked_terms(queries: DataFrame) -> DataFrame:
    """qid, q_key, term, qf: how often each query (qid, key, text) has each of its terms."""
    q = queries.select("qid", F.col("key").alias("q_key"), F.explode(T.search_tokens(F.col("text"))).alias("term"))
    return q.groupBy("qid", "q_key", "term").agg(F.count(F.lit(1)).alias("qf"))


def asked_postings(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """id, key, n, term, tf for the terms of ``asked``, and for each document one row without a term. The texts are read once and not shuffled."""
    entry = "array<struct<tokens: string, counts: int>>"
    none = F.array(F.struct(F.lit(None).cast("string").alias("tokens"), F.lit(0).alias("counts"))).cast(entry)
    each = counted(docs).select("id", "key", "n", F.inline(F.concat(none, F.arrays_zip("tokens", "counts").cast(entry))))
    each = each.withColumnsRenamed({"tokens": "term", "counts": "tf"}).join(asked.select(F.col("term").alias("t")).distinct(), F.col("term") == F.col("t"), "left")
    return each.where(F.col("t").isNotNull() | F.col("term").isNull()).drop("t")


def search(docs: DataFrame, queries: DataFrame, top: int = TOP) -> tuple[DataFrame, DataFrame]:
    """The ranking of ``rank`` from rows (id, key, text), and the postings it is of.

    Written are the queries' terms and their postings; scores are summed up where a document's
    postings are, so what is shuffled is one number for each document and query of its key.
    """
    asked = tables.written(asked_terms(queries), "asked")
    postings = tables.written(asked_postings(docs, asked), "postings")
    lens = postings.where("term is null")
    df = postings.where("term is not null").groupBy(F.col("term").alias("t")).agg(F.count(F.lit(1)).alias("df"))
    stats = F.broadcast(corpus_stats(lens))  # one row
    q = asked.join(df, F.col("term") == F.col("t")).crossJoin(stats)
    q = tables.written(q.select("qid", "q_key", F.col("t").alias("q_term"), (F.col("qf") * idf(F.col("n_docs"), F.col("df"))).alias("factor"), "avgdl"), "factors")
    m = postings.where("term is not null").join(q, (F.col("term") == F.col("q_term")) & (F.col("key") == F.col("q_key")))
    part = F.col("factor") * (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("avgdl"))))
    return ranked(m.groupBy("qid", "id").agg(F.sum(part).alias("score")), lens, queries, top), postings


def overlap_rerank(ranked: DataFrame, lens: DataFrame, queries: DataFrame) -> DataFrame:
    """Reorder candidates by the share of the query's distinct tokens that a document has (an offline stand-in for a model); ties by prior rank, id."""
    d = lens.select(F.col("id").alias("d_id"), F.array_distinct("tokens").alias("d_tokens"))
    q = queries.select(F.col("qid").alias("q_qid"), F.array_distinct(T.search_tokens(F.col("text"))).alias("q_tokens"))
    j = ranked.join(d, F.col("id") == F.col("d_id")).join(q, F.col("qid") == F.col("q_qid"))
    s = j.select("qid", "id", "rank", (F.size(F.array_intersect("q_tokens", "d_tokens")) / F.greatest(F.size("q_tokens"), F.lit(1))).alias("overlap"))
    w = W.partitionBy("qid").orderBy(F.desc(F.round("overlap", 9)), "rank", "id")
    return s.select("qid", "id", F.col("rank").alias("prior_rank"), F.round("overlap", 6).alias("overlap"), F.row_number().over(w).alias("rank"))
