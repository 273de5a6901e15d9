from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tessera.llm import suffix


def removed(docs: list[tuple[int, bytes]], length: int) -> dict[int, list[bool]]:
    best: dict[bytes, int] = {}
    for i, b in sorted(docs):
        for k in range(len(b) - length + 1):
            best.setdefault(b[k : k + length], i)
    out = {}
    for i, b in docs:
        mask = [False] * len(b)
        for k in range(len(b) - length + 1):
            if best[b[k : k + length]] < i:
                mask[k : k + length] = [True] * length
        out[i] = mask
    return out


def collection(strings: list[bytes], block: int | None = None) -> suffix.Collection:
    size = np.array([len(s) for s in strings])
    return suffix.Collection(np.frombuffer(b"".join(s.ljust(size.max(), b".") for s in strings), np.uint8).reshape(len(size), -1), size, block)


def check_order(c: suffix.Collection, strings: list[bytes]) -> None:
    c.column.rewind()
    common = c.column.read(c.n) >> 8
    found = [strings[int(o) >> 7][int(o) & 127 :] for o in c.owners()]
    assert found == sorted(s[i:] for s in strings for i in range(len(s) + 1))
    for a, b, n in zip(found, found[1:], common[1:], strict=False):
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        assert n == k


@pytest.mark.parametrize("seed", range(12))
def test_collection_is_the_sorted_suffixes(seed):
    rng = random.Random(seed)
    strings = [bytes(ord(rng.choice("abc")) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 25))]
    c = collection(strings, block=rng.choice([1, 7, 64, 1000]))
    check_order(c, strings)
    c.close()


def test_columns_are_files(monkeypatch):
    monkeypatch.setattr(suffix, "SPOOL", 100)
    strings = [b"abcabcabc" * 3, b"bcabcab" * 4, b"xyz"]
    c = collection(strings, block=16)
    assert c.column.file is not None
    check_order(c, strings)
    c.close()


def test_an_ordinary_collection_is_in_files():
    rng = np.random.default_rng(0)
    c = suffix.Collection(rng.integers(97, 123, (8192, 84)).astype(np.uint8), np.full(8192, 84))
    assert c.column.file is not None
    c.close()


def test_first_owners():
    rng = random.Random(1)
    strings = [bytes(ord(rng.choice("ab")) for _ in range(rng.randint(1, 20))) for _ in range(30)]
    docs = np.array([rng.randint(0, 9) for _ in strings])
    got = {(int(a), int(b)) for a, b in zip(*suffix.first_owners(strings, docs, 5, block=50), strict=True)}
    best: dict[bytes, int] = {}
    for s, d in zip(strings, docs, strict=True):
        for i in range(len(s) - 4):
            best[s[i : i + 5]] = min(best.get(s[i : i + 5], 99), d)
    assert got == {(k, i) for k, s in enumerate(strings) for i in range(len(s) - 4) if best[s[i : i + 5]] < docs[k]}


@pytest.mark.parametrize("batch", [3, 10, 40])
def test_a_frequent_anchor_is_split_without_loss(monkeypatch, batch):
    monkeypatch.setattr(suffix, "BATCH", batch)
    rng = random.Random(batch)
    seed = b"=the anchor 16b="
    sides = [bytes(rng.choice(b"abcdefgh") for _ in range(34)) for _ in range(6)]
    rows, size, off = [], [], []
    for _ in range(120):
        left, right = rng.choice(sides)[: rng.choice([34, 34, 20, 9])], rng.choice(sides)[: rng.choice([34, 30, 16])]
        left = left[::-1] if rng.random() < 0.1 else left
        s = left + seed + right
        s = s if len(s) >= 50 else left + seed + right + bytes(50 - len(s))
        rows.append(s.ljust(suffix.WIDTH, bytes(1)))
        size.append(len(s))
        off.append(len(left))
    docs = np.array([rng.randint(0, 60) for _ in rows])
    many = np.array([rng.random() < 0.3 for _ in rows])
    x = suffix.Segments(np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1), np.array(size), np.array(off), docs, many, 50, 16)
    found, less = x.repeated(np.arange(len(rows)))
    best: dict[bytes, list[int]] = {}
    for r, n, a, d in zip(rows, size, off, docs, strict=True):
        for i in range(max(0, a - 34), min(n - 50, a) + 1):
            best.setdefault(r[i : i + 50], []).append(d)
    mine = {(k, i) for k, (n, a) in enumerate(zip(size, off, strict=True)) for i in range(max(0, a - 34), min(n - 50, a) + 1)}
    want = {(k, i) for k, i in mine if min(best[rows[k][i : i + 50]]) < docs[k]}
    assert {(int(p) >> 7, int(p) & 127) for p in less} >= want
    assert all(any(rows[k][i : i + 50] in r[:n] and d < docs[k] for r, n, d in zip(rows, size, docs, strict=True)) for k, i in ((int(p) >> 7, int(p) & 127) for p in less))
    assert {(int(p) >> 7, int(p) & 127) for p in found} >= {(k, i) for k, i in mine if many[k]}


def test_one_anchor_in_many_contexts_stays_in_memory():
    """100,000 distinct segments of one anchor: collections of BATCH at most, and memory that does not grow with their links."""
    import tracemalloc

    rng = np.random.default_rng(3)
    n = 100_000
    rows = np.zeros((n, suffix.WIDTH), np.uint8)
    rows[:, :84] = rng.integers(97, 123, (n, 84))
    rows[:, 34:50] = 61
    rows[n // 2 : n // 2 + 100, :60] = rows[:100, :60]  # equal left sides
    x = suffix.Segments(rows, np.full(n, 84), np.full(n, 34), np.arange(n), np.zeros(n, bool), 50, 16)
    tracemalloc.start()
    _, less = x.repeated(np.arange(n))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(set((less >> 7).tolist())) == list(range(n // 2, n // 2 + 100))
    assert peak < 400 << 20


def corpus() -> list[tuple[int | None, str | None]]:
    rng = random.Random(7)
    passage = "".join(rng.choice("abcdefghij é") for _ in range(140))
    docs: list[tuple[int | None, str | None]] = []
    for i in range(60):
        own = "".join(rng.choice("klmnopqrstuvwxyz \n") for _ in range(rng.randint(0, 200)))
        cut = rng.randint(0, 60)
        docs.append((i * 3, own + passage[cut : cut + rng.choice([48, 49, 50, 51, 70, 140])] + own[::-1]))
    docs += [(1, docs[5][1]), (2, "ab" * 400), (4, "ab" * 300), (5, ""), (7, None), (8, "short"), (10, "日本語テキスト" * 12), (11, "x日本語テキスト" * 12), (None, docs[5][1])]
    return docs


def test_bytes_equal_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in docs], "doc_id long, text string, crc string, size int").repartition(5)
    rows = suffix.dedup_substrings(df, 50).collect()
    assert len(rows) == len(docs)
    masks = removed([(i, (t or "").encode()) for i, t in docs if i is not None], 50)
    texts = {i: (t or "").encode() for i, t in docs}
    for r in rows:
        b = texts[r["doc_id"]]
        m = masks[r["doc_id"]] if r["doc_id"] is not None else [False] * len(b)
        kept = bytes(c for c, x in zip(b, m, strict=True) if not x)
        spans = sum(x and (k == 0 or not m[k - 1]) for k, x in enumerate(m))
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(b), sum(m), spans)
        assert bytes(r["kept"]) == kept and r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        assert r["row"]["crc"] == "a" and r["row"]["size"] == 1


@pytest.mark.parametrize(("long", "sent", "seen"), [(64, 8, 8), (200, 1, 1), (1 << 20, 1 << 10, 1 << 10)])
def test_long_texts_and_forgetful_tasks(spark, monkeypatch, long, sent, seen):
    """Texts in parts, anchors and segments sent again: the same bytes go."""
    for name, value in (("LONG", long), ("SENT", sent), ("SEEN", seen), ("BATCH", 64)):
        monkeypatch.setattr(suffix, name, value)
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefghij é") for _ in range(300))
    docs = [(i, "".join(rng.choice("klmnopqrstuvwxyz") for _ in range(rng.randint(0, 400))) + passage[rng.randint(0, 100) :]) for i in range(40)]
    docs += [(100 + i, docs[i % 7][1]) for i in range(30)]
    import pandas as pd
    from tessera.llm.shared import arrow_schema

    base = pd.DataFrame([(i, t, 0) for i, t in docs], columns=["doc_id", "text", "crc"])
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pandas(base[k : k + 9], preserve_index=False) for k in range(0, len(base), 9)]
    rows = [r for b, f in ((b, suffix._anchor_rows(50, 16)) for b in batches) for r in f(b)]
    assert arrow_schema is not None
    cols = {k: np.concatenate([np.asarray(r[k]) for r in rows]) for k in ("h", "doc_id", "place", "win")}
    order = np.argsort(cols["h"], kind="stable")
    anchors = pa.RecordBatch.from_arrays([pa.array(v[order]) for v in cols.values()], names=list(cols))
    shared = list(suffix._shared_anchors(anchors.slice(k, 50) for k in range(0, anchors.num_rows, 50)))
    found: dict[int, list] = {}
    for b in shared:
        for d, p, w in zip(*(c.to_pylist() for c in b.columns), strict=True):
            found.setdefault(d, []).append((p, w))
    parts = []
    for third in range(3):
        data = []
        for d, t in sorted(docs):
            if d % 3 == third:
                data.append((d, 0, None, None, t))
                data += [(d, 0, p, w, None) for p, w in sorted(found.get(d, []))]
        batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in data], kind) for k, kind in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()])], names=["doc_id", "crc", "at", "upto", "text"])
        parts += list(suffix._segment_rows(50, 16)(batch.slice(k, 20) for k in range(0, batch.num_rows, 20)))
    table = pa.Table.from_batches(parts).sort_by([("h", "ascending"), ("s", "ascending"), ("doc_id", "ascending")]).combine_chunks()
    mask = {d: np.zeros(len(t.encode()), bool) for d, t in docs}
    for b in suffix._compare_segments(50, 16)(iter(table.to_batches(max_chunksize=37))):
        for d, _, a, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
            mask[d][a:z] = True
    want = removed([(d, t.encode()) for d, t in docs], 50)
    assert {d: m.tolist() for d, m in mask.items()} == want


def test_repeated_ids_and_text(spark):
    a, b = "0123456789" * 8, "abcdefghij" * 8
    df = spark.createDataFrame([(1, a), (2, a + "é"), (2, b), (2, b), (3, b)], "doc_id long, text string")
    rows = sorted((r["doc_id"], r["kept"]) for r in suffix.dedup_substrings(df, 50, as_text=True).collect())
    assert rows == [(1, a), (2, b), (2, b), (2, "é"), (3, "")]


def test_empty(spark):
    assert suffix.dedup_substrings(spark.createDataFrame([], "doc_id long, text string"), with_rows=False).count() == 0
