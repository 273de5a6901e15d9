"""Which phrases stand in which texts: one pass over each text with an Aho-Corasick automaton.

The automaton holds whole phrases, so a text is read once whatever their number, and a hit is
exact without a further look. It is built in each Python worker from a broadcast list of at
most PART_BYTES of phrases (checked); phrases beyond that are dealt by a hash to as many parts
as it takes, and the texts are passed over once a part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from tessera.sources import tables

PART_BYTES = 4 << 20  # of phrases; the automaton of a part takes some 200 MB of a worker
PART = 32  # a phrase's number is its part << PART plus its place there


def numbered(phrases: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The distinct phrases (column ``phrase``) with ``part`` and ``number``; a part has at most ``part_bytes``, or one phrase."""
    distinct = phrases.select("phrase").where("phrase <> ''").distinct()
    n = 1
    while True:
        part = F.pmod(F.xxhash64("phrase"), F.lit(n))
        sizes = distinct.groupBy(part.alias("part")).agg(F.sum(F.octet_length("phrase")).alias("bytes"), F.count(F.lit(1)).alias("n"))
        if sizes.where((F.col("bytes") > part_bytes) & (F.col("n") > 1)).isEmpty():
            break
        n *= 2
    place = F.row_number().over(W.partitionBy("part").orderBy("phrase")) - 1  # a part is bounded
    return distinct.withColumn("part", part).withColumn("number", F.shiftleft("part", PART) + place)


_automata: dict[str, object] = {}


def _automaton(words: Broadcast, key: str):
    """The automaton of a broadcast list, made once a worker; only the last one is kept."""
    if key not in _automata:
        import ahocorasick

        made = ahocorasick.Automaton()
        for i, word in enumerate(words.value):
            made.add_word(word, i)
        made.make_automaton()
        _automata.clear()
        _automata[key] = made
    return _automata[key]


def _hits(texts: DataFrame, id_col: str, text: str, words: Broadcast, part: int) -> DataFrame:
    rows = texts.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("text <> ''")
    schema = StructType([rows.schema["id"], StructField("number", LongType())])
    kinds, key, first = to_arrow_schema(schema), uuid.uuid4().hex, part << PART

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _automaton(words, key)
        for batch in batches:
            at: list[int] = []
            found: list[int] = []
            for i, t in enumerate(batch.column("text")):  # one text at a time as a string
                here = {k for _, k in find.iter(t.as_py())}
                found += sorted(here)
                at += [i] * len(here)
            ids = batch.column("id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids.cast(kinds[0].type), pa.array([first + k for k in found], pa.int64())], schema=kinds)

    tables.small_batches(texts.sparkSession)
    return rows.mapInArrow(run, schema)


def contained(texts: DataFrame, phrases: DataFrame, id_col: str = "id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """phrase_id, phrase and id of every phrase (phrase_id, phrase) in every text (id, text) that holds it.

    Null and empty phrases are in no text, null and empty texts hold none. Equal phrases are
    looked for once and each of their ids gets the hits; rows that repeat an id get hits of
    their own. Phrases may overlap and hold one another.
    """
    spark = texts.sparkSession
    known = tables.written(numbered(phrases, part_bytes), "phrases")
    hits = None
    for part in sorted(r["part"] for r in known.select("part").distinct().collect()):  # one a part
        words = spark.sparkContext.broadcast([r["phrase"] for r in known.where(F.col("part") == part).orderBy("number").select("phrase").collect()])
        one = _hits(texts, id_col, text, words, part)
        hits = one if hits is None else hits.unionByName(one)
    if hits is None:
        hits = texts.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("number")).where("false")
    ids = phrases.join(known.select(F.col("phrase").alias("p"), "number"), F.col("phrase") == F.col("p")).select("phrase_id", "phrase", F.col("number").alias("k"))
    return hits.join(ids, F.col("number") == F.col("k")).select("phrase_id", "phrase", F.col("id").alias(id_col))
