"""Fixed windows over the tokens of a tokenizer file.

The token count of a window is that of its text read anew, as an embedding service would
count it: a window ends at the last place where that is within the limit.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources import tables

from .chunk import OVERLAP, SIZE

SCHEMA = "ordinal int, token_start int, token_end int, token_count int, exact boolean, chunk_text string, text_sha256 string"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> tuple[Callable[[str], list[int]], Callable[[list[int]], str]]:
    """Encoding and decoding by a tokenizer file, without special tokens; encoding by the faster engine of ``llm.tokens``, whose ids are the same, where it is there."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)

    def decode(ids: list[int]) -> str:
        return t.decode(ids, skip_special_tokens=True)

    try:
        from tessera.llm import tokens
    except ImportError:
        return lambda text: t.encode(text, add_special_tokens=False).ids, decode
    encode = tokens.encoder(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if (spec.get("decoder") or {}).get("type") != "ByteLevel":
        return lambda text: encode(text).tolist(), decode
    special = {x["id"] for x in spec.get("added_tokens") or () if x.get("special")}
    part = [b"" if i in special else x for i, x in enumerate(tokens.token_bytes(path))]
    return lambda text: encode(text).tolist(), lambda ids: b"".join([part[i] for i in ids]).decode("utf-8", "replace")


def token_windows(ids: list[int], encode: Callable, decode: Callable, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple[int, int, str, list[int]]]:
    """(start, end, text, ids of the text) of the windows; each begins ``overlap`` tokens before the end of the one before."""
    start, end = 0, 0
    while end < len(ids):
        ends = range(min(start + size, len(ids)), start, -1)
        fits = ((e, text, again) for e in ends if len(again := encode(text := decode(ids[start:e]))) <= size)
        end, text, again = next(fits, (start, "", []))
        if not text.strip() or (end < len(ids) and end - overlap <= start):
            raise ValueError(f"no window of at most {size} tokens goes on from token {start}")
        yield start, end, text, again
        start = end - overlap


def token_chunks(docs: DataFrame, path: str, size: int = SIZE, overlap: int = OVERLAP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks of at most ``size`` tokens with their ids by the tokenizer of ``path``: doc_id, ordinal, token_start, token_end, token_count, exact, chunk_text, text_sha256, chunk_id.

    Null and blank texts have no chunks. ``exact``: the text's tokens are those of the document.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode = tokenizer(path)
        for batch in batches:
            for i, t in enumerate(batch.column(1)):
                t = t.as_py() or ""
                rows = [
                    {"ordinal": k, "token_start": a, "token_end": b, "token_count": len(again), "exact": again == ids[a:b], "chunk_text": x, "text_sha256": hashlib.sha256(x.encode()).hexdigest()}
                    for ids in ([encode(t)] if t.strip() else [])
                    for k, (a, b, x, again) in enumerate(token_windows(ids, encode, decode, size, overlap))
                ]
                if rows:
                    part = pa.RecordBatch.from_pylist(rows, schema=pa.schema([("ordinal", pa.int32()), ("token_start", pa.int32()), ("token_end", pa.int32()), ("token_count", pa.int32()), ("exact", pa.bool_()), ("chunk_text", pa.string()), ("text_sha256", pa.string())]))
                    key = pa.concat_arrays([batch.column(0).slice(i, 1)] * len(rows))
                    yield pa.RecordBatch.from_arrays([key, *part.columns], names=["doc_id", *part.schema.names])

    tables.small_batches(docs.sparkSession)
    out = docs.select(F.col(doc_id).alias("doc_id"), text).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
    return out.withColumn("chunk_id", F.format_string(f"%s__tokens_{size}_{overlap}__%06d__%s", F.col("doc_id").cast("string"), "ordinal", "text_sha256"))
