from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from oracle import DATA
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tessera.llm import alignment, queries, tokens

A, B = alignment.default_paths()


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def brute(rows, libraries):
    """(id, n_a .. n_links, n_best, count_sum, groups) by byte ends, text by text."""
    a, b = libraries
    data_a, data_b = tokens.token_bytes(A), tokens.token_bytes(B)
    out, counts = [], Counter()
    for i, text in rows:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if {b"".join(data_a[t] for t in x), b"".join(data_b[t] for t in y)} != {b" " + text.encode()} if text else True:
            x, y = [], []
        ends = []
        for ids, data in ((x, data_a), (y, data_b)):
            at, e = 0, []
            for t in ids:
                at += len(data[t])
                e.append(at)
            ends.append(e)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, links, at = [], [], [0, 0]
        for c in cuts:
            upto = [e.index(c, k) + 1 for e, k in zip(ends, at, strict=True)]
            groups.append("|".join(",".join(map(str, ids[k:u])) for ids, k, u in zip((x, y), at, upto, strict=True)))
            links.append((x[upto[0] - 1], y[upto[1] - 1]))
            at = upto
        counts.update(links)
        out.append((i, len(x), len(y), len(cuts), links, ";".join(groups)))
    most: dict = {}
    for (_, q), n in counts.items():
        most[q] = max(most.get(q, 0), n)
    return [(i, n, m, g, len(ls), sum(counts[p] == most[p[1]] for p in ls), sum(counts[p] for p in ls), t) for i, n, m, g, ls, t in out]


TEXTS = [
    None, "", " ", "a plain sentence, with Ünïcödé and 漢字 and 🙂!", "two  spaces", "tabs\tand\nlines", "<|endoftext|> as text </s> <unk> <0x41>", "▁ as itself", "ﬁ ligature", "é composed", "x", "123456 7.89",
    "don't we'll I'd", " no-break", "repeat repeat repeat repeat", "ends with space ", "A" * 300, "café" * 40, "\x00 zero", "日本語のテキスト", "a-b_c/d",
]


@pytest.mark.parametrize("frequent", [0, 20, alignment.FREQUENT])
def test_alignment_equals_brute_force(spark, libraries, frequent):
    """Nulls, empty and changed texts, special tokens' texts, repeated rows and ids, ties, further columns with clashing names; all, some or no pairs rare."""
    rng = random.Random(4)
    words = "the of and to in that it with as for tokenizers alignment bytes überall straße naïve co-operate 2024".split()
    texts = TEXTS + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[-1])]
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, pair string, rid int")
    got = alignment.align(docs, A, B, frequent=frequent)
    want = brute(rows, libraries)
    assert sorted((tuple(r)[:8] for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert {(r["groups"], r["groups_sha256"]) for r in got.collect()} == {(t, hashlib.sha256(t.encode()).hexdigest() if t else "") for *_, t in want}
    assert alignment.align(docs.where("false"), A, B).collect() == []


def test_query_equals_brute_force(spark, libraries):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    want = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in brute(rows, libraries)]
    assert sorted((tuple(r) for r in queries.op13_alignment(spark, DATA).collect()), key=repr) == sorted(want, key=repr)


def test_very_long_text(spark):
    text = ("word and " * 40_000)[:-1]
    r = alignment.align(spark.createDataFrame([(1, text)], "doc_id long, text string"), A, B).first()
    assert r["n_groups"] == r["n_links"] == 80_000 and r["n_a"] == r["n_b"] == 80_000


def plain_union(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("seed", range(30))
def test_union_and_components_are_minimal_groups(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 60)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 60))]
    u, v = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
    assert alignment.union(n, u, v).tolist() == plain_union(n, edges)
    total = rng.randint(1, 80)
    cuts = [sorted({total, *(rng.randint(1, total) for _ in range(rng.randint(0, 40)))}) for _ in range(2)]
    lens = [np.diff([0, *c]) for c in cuts]
    ga, gb, i, j = alignment.groups_and_links(*lens)
    shared = sorted(set(cuts[0]) & set(cuts[1]))
    assert [sum(s < c for s in shared) for c in cuts[0]] == ga.tolist() and [sum(s < c for s in shared) for c in cuts[1]] == gb.tolist()
    assert [cuts[0][x] for x in i] == shared == [cuts[1][x] for x in j]


def test_frequent_pairs_are_bounded():
    assert alignment.frequent_from([(3, 5), (2, 10), (1, 100)], 15) == 2
    assert alignment.frequent_from([(3, 50)], 15) > 3
    assert alignment.frequent_from([], 15) > 0
