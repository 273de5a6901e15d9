from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing, tokens


def best(items, capacity):
    items, out = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= out[0]:
            return
        if i == len(items):
            out[0] = len(bins)
            return
        for free in {b for b in bins if b >= items[i]}:
            k = bins.index(free)
            bins[k] -= items[i]
            go(i + 1, bins)
            bins[k] += items[i]
        bins.append(capacity - items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return out[0]


def check_plan(plan, histogram, capacity):
    fill: dict = {}
    runs = np.array(sorted(plan.runs))
    for length, n in histogram.items():
        for s, o in zip(*packing.locate(runs, np.full(n, length), np.arange(n)), strict=True):
            fill.setdefault(int(s), []).append((int(o), length))
    assert sorted(fill) == list(range(plan.sequences))
    for parts in fill.values():
        at = 0
        for o, length in sorted(parts):
            assert o == at
            at += length
        assert at <= capacity


@pytest.mark.parametrize("seed", range(40))
def test_dominance_never_costs_a_sequence(seed, monkeypatch):
    rng = random.Random(seed)
    capacity = rng.choice([10, 20, 37])
    items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 11))]
    histogram = {s: items.count(s) for s in items}
    check_plan(packing.best_fit_decreasing(dict(histogram), capacity), histogram, capacity)
    check_plan(packing.dominance_then_best_fit(dict(histogram), capacity), histogram, capacity)
    rest = {}

    def stop(have, capacity, plan):
        rest.update(have)
        return plan

    monkeypatch.setattr(packing, "best_fit_decreasing", stop)
    fixed = packing.dominance_then_best_fit(dict(histogram), capacity).sequences
    assert fixed + best([s for s, n in rest.items() for _ in range(n)], capacity) == best(items, capacity)


def test_plan_of_many_pieces_stays_small():
    rng = random.Random(0)
    histogram: dict = {}
    for _ in range(100_000):
        s = min(1024, max(1, int(rng.lognormvariate(6, 0.9))))
        histogram[s] = histogram.get(s, 0) + 1
    plan = packing.dominance_then_best_fit(dict(histogram), 1024)
    total = sum(s * n for s, n in histogram.items())
    assert plan.sequences <= 1.005 * total / 1024 and len(plan.runs) < 10_000


def test_capacity_tree():
    t = packing.CapacityTree(20)
    for free in (3, 7, 7, 20):
        t.add(free, 1)
    assert [t.at_least(s) for s in (1, 3, 4, 7, 8, 20)] == [3, 3, 7, 7, 20, 20]
    t.add(20, -1)
    assert t.at_least(8) is None


TEXTS = [(1, "It's a test, isn't it? " * 300), (2, ""), (3, None), (4, "<|endoftext|> 中文 ١٢ 'S\n\n  x "), (5, "word"), (5, "word"), (None, "no id")]


def expected(text):
    return [*Tokenizer.from_file(tokens.default_path()).encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|><|endoftext|>\n", "<|endoftext", "\u3000\u3000x\xa0\xa0 y\x85z\x1cq\u2028", "it's I'LL 'Re", "𝒳🏳️\u200d🌈 é e\u0301", " " * 2_000_000, "\n" * 2_000_000, "x" + " \t" * 900_000 + "y", "z" * 500_000])
def test_ids_are_those_of_the_library(text):
    assert tokens.encoder(tokens.default_path())(text).tolist() == expected(text)[:-1]


def test_ids_of_random_texts_and_of_the_vocabulary():
    import json

    rng = random.Random(1)
    signs = [chr(c) for c in (*range(0x250), *range(0x2000, 0x2070), 0x3000, 0x4E00, 0x1F600, 0x0301, 0xFEFF, 0x200B)]
    texts = ["".join(rng.choice(signs if rng.random() < 0.6 else list(" \n\t'stmdrvel0aA.")) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    with open(tokens.default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    assert tokens._mergeable(spec)
    alphabet = tokens._byte_alphabet()
    for token in list(spec["model"]["vocab"])[::7]:
        if all(c in alphabet for c in token):
            texts.append(bytes(alphabet[c] for c in token).decode("utf-8", "replace"))
    library, encode = Tokenizer.from_file(tokens.default_path()), tokens.encoder(tokens.default_path())
    for t in texts:
        assert encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_other_files_are_run_by_the_library(tmp_path):
    import json

    spec = {"version": "1.0", "added_tokens": [], "pre_tokenizer": {"type": "Whitespace"}, "model": {"type": "WordLevel", "vocab": {"a": 7, "b": 9, "[U]": 1}, "unk_token": "[U]"}}
    (tmp_path / "t.json").write_text(json.dumps(spec))
    assert tokens.encoder(str(tmp_path / "t.json"))("b a c").tolist() == [9, 7, 1]


def test_pack_documents(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in TEXTS], "doc_id long, text string, offset int")
    rows = packing.pack_documents(df, tokens.default_path(), 64).collect()
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, t in dict(TEXTS).items():
        ids = expected(t)
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        parts = parts[:: 2 if i == 5 else 1]
        assert [r["start"] for r in parts] == [s for s, _ in tokens.cuts(len(ids), 64)] and sum(r["length"] for r in parts) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in parts)
    places: dict = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    assert packing.pack_documents(df.limit(0), tokens.default_path()).count() == 0


def naive_best_fit(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= n
        else:
            free.append(capacity - n)
    return free


def test_matrices_are_lossless(spark, tmp_path):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    out = packing.write_matrices(df.repartition(2), tokens.default_path(), 32)
    rows = out.collect()
    pieces: dict = {}
    for r in rows:
        row = np.frombuffer(r["input_ids"], f"<u{r['id_bytes']}")
        assert len(row) == 32 and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] and not row[r["n_tokens"] :].any()
        assert r["position_resets"] == (r["cu_seqlens"] if r["n_tokens"] < 32 else r["cu_seqlens"][:-1])
        for a, b, d, p, start in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["doc_ids"], r["pieces"], r["starts"], strict=False):
            pieces.setdefault(d, []).append((p, start, row[a:b].tolist()))
    for i, t in TEXTS:
        parts = sorted(pieces[i])[:: 2 if i == 5 else 1]
        assert sum((x for _, _, x in parts), []) == expected(t)
        assert [s for _, s, _ in parts] == list(np.cumsum([0] + [len(x) for _, _, x in parts])[:-1])
    lengths = [len(x) for p in pieces.values() for _, _, x in p]
    assert sorted(32 - r["n_tokens"] for r in rows) == sorted(naive_best_fit(lengths, 32))
    packing.save_matrices(out, str(tmp_path / "m"))
    again = spark.read.parquet(str(tmp_path / "m"))
    key = lambda r: r["sequence_id"]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    assert sorted(packing.write_matrices(df.repartition(3, "text"), tokens.default_path(), 32).collect(), key=key) == sorted(rows, key=key)
    assert packing.write_matrices(df.limit(0), tokens.default_path()).count() == 0


def test_groups_are_bounded(spark, monkeypatch):
    """Many groups, and equal rows beyond a group's size: nothing is lost."""
    monkeypatch.setattr(packing, "GROUP_BYTES", 300)
    texts = [(1, "same words again and again " * 5)] * 30 + [(i, f"text {i} " * (i % 9)) for i in range(50)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = packing.write_matrices(df, tokens.default_path(), 32).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and len({r["sequence_id"] >> 32 for r in rows}) > 5
    assert sum(r["n_tokens"] for r in rows) == sum(len(expected(t)) for _, t in texts)


def test_ranks_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 3)
    df = spark.createDataFrame([(i, "word " * (i % 4)) for i in range(60)], "doc_id long, text string")
    rows = packing.pack_documents(df, tokens.default_path(), 16).collect()
    places: dict = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(rows) == 60
    for parts in places.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 16
