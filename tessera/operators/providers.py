"""Interfaces of model services and offline stand-ins.

The stand-ins are no models: embeddings are hashed bags of tokens, the reranker counts
common tokens, the generator quotes, the judge looks for the quote. Their names say so.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    def generate(self, question: str, evidence: list[str]) -> list[dict]: ...


class Judge(Protocol):
    def judge(self, claims: list[dict]) -> list[bool | None]: ...


def hashed_bag_embedding(text: Column, dimension: int = 64) -> Column:
    """An offline stand-in for an embedding: counts of tokens by hash, at length one; JVM only."""
    slots = F.transform(T.search_tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dimension)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    n = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: F.when(n > 0, x / n).otherwise(0.0))


def embed_with(rows: DataFrame, embedder: Embedder, text: str = "text", batch: int = 16) -> DataFrame:
    """``rows`` with ``embedding`` from a service, asked in batches; its answers must be complete and of its dimension."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", embedding array<double>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out: list[list[float]] = []
            for i in range(0, len(part), batch):
                texts = part[text].iloc[i : i + batch].fillna("").tolist()
                found = embedder.embed(texts)
                if len(found) != len(texts) or any(len(v) != embedder.dimension for v in found):
                    raise ValueError("the embedding service left out vectors or changed their dimension")
                out += found
            yield part.assign(embedding=out)

    return rows.mapInPandas(run, schema)


def quoting_generator(question: Column, evidence: Column) -> Column:
    """An offline stand-in for generation: one claim that quotes the first 360 characters of the evidence."""
    return F.struct(T.preview(evidence, 360).alias("quote"), F.concat(F.lit("The evidence says: "), T.preview(evidence, 360)).alias("text"))


def quote_judge(claim_quote: Column, evidence: Column) -> Column:
    """An offline stand-in for a judge: true if the quote stands in the evidence, null without evidence."""
    return F.when(evidence.isNotNull(), T.contains_literally(evidence, claim_quote))
