"""A training corpus from raw documents: five stages, each on all that the stage before kept.

toxicity          documents that the string-kernel machine rejects go
minhash           of each group of near-duplicates one document stays
suffix            bytes covered by 50-byte strings of an earlier document are cut out
mixing            documents are taken, repeated or left so that sources reach their weights
packing           what the mix takes is packed into sequences of 1024 tokens

All but the last return the columns of ``documents``; between stages the table is written
and read again.

Null, empty and blank texts pass the first three stages as they are (a null becomes empty when
substrings are cut), the mix takes none of them, and in packing such a document is its end
token alone. Rows without doc_id pass: they lose no substring and cause no loss. Rows that
repeat a doc_id go together when near-duplicates are dropped. Texts of any length are read
whole. Columns beside those of ``documents`` are dropped, whatever their names. No rows give
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import minhash, mixing, packing, suffix, tokens, toxicity
from tessera.llm.shared import materialize, release

REJECT = toxicity.THRESHOLD  # probability of toxicity from which a document goes
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The last stage is a packing of token ids and the first learns a model; SQL expresses neither.
ORACLE_SQL = None


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below REJECT; the machine learns from the labelled rows among them, outside the held-out fold."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_texts(docs, model, COLUMNS).where(F.col("score") < REJECT).select(COLUMNS)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are the smallest doc_id of their group (shingles of 5 words, similarity 0.8)."""
    found = minhash.near_duplicates(docs, width=5, percent=80)
    gone = materialize(found.where("not kept").select(F.col("doc_id").alias("gone")).distinct(), "near-duplicates")
    return docs.join(gone, F.col("doc_id") == F.col("gone"), "left_anti").select(COLUMNS)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 bytes or more that a smaller doc_id has; a character that a cut splits goes."""
    found = suffix.dedup_substrings(docs.select(COLUMNS), 50, as_text=True)
    rows = found.select("doc_id", F.col("kept").alias("text"), "row.lang", "row.source")
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as a mix at weights 1, 2, 3 takes it: none to three times."""
    found = mixing.mix_sources(docs.select(COLUMNS), (1, 2, 3), 3, with_rows=True)
    times = F.sequence(F.lit(1), F.try_divide("taken", "size").cast("int"))
    return found.where("taken > 0").select("row", F.explode(times)).select([f"row.{c}" for c in COLUMNS])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 ids."""
    return packing.pack_documents(docs, tokens.default_path(), 1024)


STAGES = [("toxicity", toxic_out), ("minhash", near_duplicates_out), ("suffix", repeats_out), ("mixing", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    before = None
    for name, stage in STAGES[:-1]:
        after = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            release(before)
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)
