"""The packing queries over a whole given table, against the library that made the tokenizer file."""

from __future__ import annotations

import zlib

import numpy as np
from oracle import DATA
from tokenizers import Tokenizer

from tessera.llm import queries, tokens


def ids_by_document(spark):
    library = Tokenizer.from_file(tokens.default_path())
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in rows}


def best_fit(lengths, capacity):
    free: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            free.remove(min(fits))
        free.append((min(fits) if fits else capacity) - n)
    return len(free)


def test_op8_whole_table(spark):
    want, places, pieces = ids_by_document(spark), {}, {}
    for r in queries.op8_packing(spark, DATA).collect():
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces.keys() == want.keys()
    for i, parts in pieces.items():
        assert [(p, s) for p, s, _ in sorted(parts)] == list(enumerate(np.cumsum([0] + [n for *_, n in sorted(parts)])[:-1]))
        assert sum(n for *_, n in parts) == len(want[i]) and all(n == 1024 for *_, n in sorted(parts)[1:]) and len(parts) == -(-len(want[i]) // 1024)
    for parts in places.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 1024
    lengths = [n for parts in pieces.values() for *_, n in parts]
    assert -(-sum(lengths) // 1024) <= len(places) <= best_fit(lengths, 1024)


def test_op5_whole_table(spark):
    want, pieces, n = ids_by_document(spark), {}, 0
    for r in queries.op5_token_matrices(spark, DATA).collect():
        row, n = np.frombuffer(r["input_ids"], f"<u{r['id_bytes']}"), n + 1
        assert len(row) == 2048 and r["cu_seqlens"][-1] == r["n_tokens"] <= 2048
        for a, b, d, p, start in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["doc_ids"], r["pieces"], r["starts"], strict=False):
            pieces.setdefault(d, []).append((p, start, row[a:b].tolist()))
    assert {i: sum((x for *_, x in sorted(p)), []) for i, p in pieces.items()} == want
    assert all([s for _, s, _ in sorted(p)] == list(np.cumsum([0] + [len(x) for *_, x in sorted(p)])[:-1]) for p in pieces.values())
    assert n <= best_fit([len(x) for p in pieces.values() for *_, x in p], 2048)
