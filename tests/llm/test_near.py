from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest

from tessera.llm import embeddings, minhash
from tessera.llm.components import components


def groups(n: list, links: list[tuple]) -> dict:
    parent = {i: i for i in n}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)] + [(5, 5)]
    rows = spark.createDataFrame(links, "a long, b long")
    want = groups(sorted({x for p in links for x in p}), links)
    assert {r["id"]: r["component"] for r in components(rows).collect()} == {i: c for i, c in want.items() if i != c}


def plain_superminhash(elements, m):
    out = np.full(m, 2**64 - 1, np.uint64)
    seeds = minhash.stream(4242, m)
    for e in elements:
        p = list(range(m))
        for j in range(m):
            x = int(minhash.mix(np.array([e ^ seeds[j]]))[0])
            k = j + ((x >> 32) * (m - j) >> 32)
            p[j], p[k] = p[k], p[j]
            out[p[j]] = min(out[p[j]], np.uint64((j << 32) | (x & 0xFFFFFFFF)))
    return out


@pytest.mark.parametrize("n", [1, 3, 40, 300])
def test_superminhash_equals_the_sequential_form(n):
    sets = [minhash.stream(n + s, n) for s in range(3)]
    got = minhash.superminhash(np.concatenate(sets), np.arange(0, 3 * n + 1, n), 24)
    assert all((g == plain_superminhash(s, 24)).all() for g, s in zip(got, sets, strict=True))


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def near_corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 60, 200]))]
        for _ in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            docs.append(" ".join(words))
    docs += [docs[0].upper(), docs[0], "", None, " \n\t", "one two three", "one  two\tTHREE", "x " * 3000]
    return list(enumerate(docs))


def check_near(spark, docs, width):
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n int").repartition(3)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, width=width).collect()}
    sets = {i: shingles(t, width) for i, t in docs}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = groups(list(sets), links)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    check_near(spark, near_corpus(), width)


def test_large_groups_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 6)
    monkeypatch.setattr(minhash, "PIVOTS", 2)
    check_near(spark, near_corpus(), 4)


def test_rows_without_id_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (None, None)], "doc_id long, text string")
    rows = minhash.near_duplicates(df).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in rows) == [(-1, -1, True), (-1, -1, True), (1, 1, True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def vectors():
    rng = np.random.default_rng(2)
    rows: list[tuple] = []
    for g in range(30):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 8)):
            rows.append((base + rng.normal(0, 0.07 * rng.random(), 16)).tolist())
    rows += [rows[0], [2 * x for x in rows[0]], [0.0] * 16, None, [], [float("nan")] * 16, [None] * 16, [float("inf")] * 16, rows[0][:8]]
    return [(i, v, int(rng.integers(0, 3)) if i % 17 else None) for i, v in enumerate(rows)]


@pytest.mark.parametrize("block", [1024, 3])
def test_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame([(i, v, y, "x") for i, v, y in rows], "vec_id long, embedding array<double>, label int, key string")
    got = {r["vec_id"]: r for r in embeddings.near_vectors(df).collect()}
    unit = {}
    for i, v, y in rows:
        if v and y is not None and None not in v and np.isfinite(v).all() and any(v):
            unit[i] = (np.array(v) / np.linalg.norm(v), y)
    links = [(a, b) for a, b in combinations(unit, 2) if unit[a][1] == unit[b][1] and len(unit[a][0]) == len(unit[b][0]) and unit[a][0] @ unit[b][0] >= 0.98]
    want = groups([r[0] for r in rows], links)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_links"] for i, r in got.items()} == {r[0]: sum(r[0] in p for p in links) for r in rows}


def plain_links(rows):
    """Rows (vec_id, vector, label), all comparable: links and the smallest vec_id of each row's component."""
    unit = [np.array(v, float) / np.linalg.norm(v) for _, v, _ in rows]
    links = [(a, b) for a, b in combinations(range(len(rows)), 2) if rows[a][2] == rows[b][2] and unit[a] @ unit[b] >= 0.98]
    part = groups(list(range(len(rows))), links)
    least = {p: min(rows[i][0] for i in part if part[i] == p) for p in set(part.values())}
    return sorted((r[0], sum(i in p for p in links), least[part[i]]) for i, r in enumerate(rows))


def test_repeated_vec_ids(spark):
    rows = [(1, [1.0, 0.0], 5), (1, [1.0, 0.01], 5), (2, [1.0, 0.02], 5), (3, [0.0, 1.0], 5), (3, [-1.0, 0.0], 5), (9, [1.0, 0.0], 5), (4, [0.01, 1.0], 5)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == plain_links(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize(("kind", "labels"), [("double", [1.2, 1.7, -0.0, 0.0]), ("string", ["a", "A", "a ", ""]), ("boolean", [True, False, True, False])])
def test_labels_as_they_are(spark, kind, labels):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((6, 12))
    rows = [(i, (base[i % 6] + rng.normal(0, 0.02, 12)).tolist(), labels[i % 4]) for i in range(48)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label {kind}")).collect()
    rows = [(i, np.array(v, np.float32).tolist(), y) for i, v, y in rows]
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == plain_links(rows)


def test_vec_ids_of_text(spark):
    rows = [("b", [1.0, 0.0], 1), ("a", [1.0, 0.01], 1), ("c", [0.0, 1.0], 1)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id string, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [("a", 1, "a", True), ("b", 1, "a", False), ("c", 0, "c", True)]
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_recall_at_the_least_cosine():
    """Of 20,000 pairs at a cosine of exactly 0.98 in 64 dimensions hardly one shares no bucket; far ones share few."""
    rng = np.random.default_rng(4)
    a = rng.standard_normal((20_000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((20_000, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.98 * a + np.sqrt(1 - 0.98**2) * b
    hashing = embeddings.Hashing(embeddings.TABLES, embeddings.PROJECTIONS, embeddings.WIDTH)
    none = np.zeros(20_000, np.int64)
    assert (hashing.keys(a, none) == hashing.keys(near, none)).any(1).mean() >= 0.9995
    assert (hashing.keys(a, none) == hashing.keys(b, none)).any(1).mean() <= 0.005
    some = rng.permutation(20_000)[:77]
    assert (hashing.keys(a, none)[some] == hashing.keys(a[some], none[:77])).all()
