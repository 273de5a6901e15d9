from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tessera.llm import labelled, quality, toxicity
from tessera.llm.shared import column_bytes

DATA = "/root/testdata/sf0.1"


def test_fold(spark):
    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    rows = df.select("doc_id", labelled.held_out(df.doc_id).alias("h")).collect()
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


def toy(n: int = 300):
    rng = random.Random(1)
    usual = ["".join(rng.choice("aeiou") + rng.choice("lnrst") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = [rng.choice(usual) for _ in range(40)]
        toxic = i % 3 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(["zombick", "gwurf", "plimp"])
        rows.append((" ".join(words) + ".", int(toxic)))
    return rows


def features(model, text):
    return toxicity.document_features(*column_bytes(pc.utf8_lower(pa.array([text], pa.string()))), model)


def score(model, text):
    return model.probability(features(model, text))[0]


def test_toxicity_learns_words_and_gaps():
    m = toxicity.train(toy())
    clean = max(score(m, t) for t, y in toy() if not y)
    for word in ("zombick", "ZOMBICK", "z.o.m.b.i.c.k", "zom-bick", "z o m b i c k", "zombiick"):
        assert score(m, f"nasa lere {word} tonu") > clean, word
    assert (features(m, "") == toxicity.NOTHING).all() and score(m, "") < 0.3


def kernel(a: str, b: str) -> float:
    def features(word):
        total, square = {}, 0.0
        for _, feature, weight in toxicity.occurrences(toxicity.joined([word])):
            for f in feature.tolist():
                total[f] = total.get(f, 0.0) + weight
                square += weight**2
        return total, square

    (x, nx), (y, ny) = features(a), features(b)
    return sum(w * y.get(f, 0.0) for f, w in x.items()) / np.sqrt(nx * ny)


def test_features_give_the_kernel_and_fold_into_weights():
    words = ["idiot", "clown", "usual", "clowns"]
    z = toxicity.landmark_features(words)
    x = toxicity.nystrom(words, z)
    assert np.allclose(x @ x.T, [[kernel(a, b) for b in words] for a in words], atol=1e-3)
    w = np.random.default_rng(1).normal(size=x.shape[1])
    model = toxicity.plain_model((z.project @ w).astype(np.float32)[z.place], 0.25)
    assert np.allclose(toxicity.fragment_margins(toxicity.joined(words), len(words), model), x @ w + 0.25, atol=1e-3)


def test_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    width = (1 << quality.WORD_BITS) + quality.STATISTICS
    m = quality.Model(0.3, rng.normal(0, 0.1, width), rng.normal(0, 0.1, (width, quality.RANK)), np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS))
    data, offsets = column_bytes(pa.array(["Some words here, some more.", "", None, "A b\nC d!"]))
    doc, feature, value, statistics = quality.features(data, offsets)
    got = m.score(doc, feature, value, statistics)
    for d in range(4):
        index = np.concatenate([feature[doc == d], (1 << quality.WORD_BITS) + np.arange(quality.STATISTICS)])
        x = np.concatenate([value[doc == d], np.clip(statistics[d], -4, 4)])
        z = m.bias + m.linear[index] @ x + sum(m.vectors[index[i]] @ m.vectors[index[j]] * x[i] * x[j] for i in range(len(x)) for j in range(i))
        assert got[d] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_document_features_against_plain_python():
    m = toxicity.train(toy())
    texts = [t for t, _ in toy()[:5]] + ["zombick zombick gwurf nasa", "z o m b i c k nasa\tnasa", "", None, "  \n", "plimp"]
    data, offsets = column_bytes(pc.utf8_lower(pa.array(texts)))
    got = toxicity.document_features(data, offsets, m)
    assert all(np.allclose(g, features(m, t)[0], atol=1e-6) for g, t in zip(got, texts, strict=True))
    for g, t in zip(got, texts, strict=True):
        words = (t or "").lower().split()
        known = {w: float(toxicity.fragment_margins(toxicity.joined([w]), 1, m)[0]) for w in words}
        for x in toxicity.spelt((t or "").lower()):
            known[x + "\0"] = float(toxicity.fragment_margins(toxicity.joined([x]), 1, m)[0])
        # a word with signs among its letters also counts by its letters alone
        for w in set(words):
            plain = "".join(c for c in w if c.isalnum())
            if 1 < len(plain) < len(w):
                known[w] = max(known[w], float(toxicity.fragment_margins(toxicity.joined([plain]), 1, m)[0]))
        top = sorted((max(v, -1.0) for v in known.values()), reverse=True) + [-1.0, -1.0]
        assert g[:2] == pytest.approx(top[:2], abs=1e-4)
        assert g[2] == pytest.approx(np.log1p(sum(max(v, 0) for v in known.values())), abs=1e-4)
        assert g[3] == pytest.approx(np.log(len(words)) if words else 0.0)
        assert g[4] == pytest.approx(sum(max(known[w], 0) for w in words) / np.sqrt(len(words)) if words else 0.0, abs=1e-4)


@pytest.mark.parametrize(("operator", "label", "precision", "recall"), [(quality.quality, "quality", 0.9, 0.9), (toxicity.toxicity, "toxic", 0.85, 0.9)])
def test_held_out_rows(spark, operator, label, precision, recall):
    """Precision and recall of label 1 on the fold that is not learnt from."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    out = operator(docs, labels)
    assert out.count() == docs.count()
    judged = out.where("held_out").join(labels, "doc_id").select("predicted", label).collect()
    found = sum(r["predicted"] == 1 and r[label] == 1 for r in judged)
    assert found / sum(r["predicted"] for r in judged) >= precision and found / sum(r[label] for r in judged) >= recall


def test_repeated_ids_are_one_example(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(3, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 0)], "doc_id long, toxic int")
    assert sorted(tuple(r) for r in labelled.training_rows(docs, labels, "toxic").collect()) == [(1, "text 0", 1), (3, "other", 0)]


@pytest.mark.parametrize(("operator", "label"), [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_no_labels_and_odd_rows(spark, operator, label):
    docs = spark.createDataFrame([(1, "text", 1), (2, None, 1), (None, "", 1), (2, None, 1), (5, "é" * 50_000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = operator(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert operator(docs.limit(0), labels).count() == 0


def phrase_toy(n: int = 600):
    """Documents with the same usual words, of which a third has three of them as one phrase."""
    rng = random.Random(3)
    usual = ["".join(rng.choice("aeiou") + rng.choice("lnrst") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    phrase = [usual[3], usual[17], usual[29]]
    rows = []
    for i in range(n):
        words = [rng.choice(usual) for _ in range(40)]
        for p in phrase:
            words[rng.randrange(40)] = p
        if i % 3 == 0:
            k = rng.randrange(37)
            words[k : k + 3] = phrase
        for k in (9, 19, 29, 39):
            words[k] += "."
        rows.append((" ".join(words), int(i % 3 == 0)))
    return rows


def test_toxicity_of_phrases_of_usual_words():
    rows = phrase_toy()
    m = toxicity.train(rows[:400])
    called = np.array([score(m, t) for t, _ in rows[400:]]) >= 0.3
    toxic = np.array([y for _, y in rows[400:]]) == 1
    assert called[toxic].mean() >= 0.75 and called[~toxic].mean() <= 0.15


def test_toxicity_of_words_that_are_split():
    m = toxicity.train(toy())
    clean = max(score(m, t) for t, y in toy() if not y)
    for word in ("zom bick", "zo mbick", "zomb ick", "gw urf"):
        assert score(m, f"nasa lere {word} tonu") > clean, word


def test_vectors_of_sentences_against_brute_force():
    texts = ["One  two.\nthree! ", "", " ", "a.b c\n\nd", "ü" * 130 + " é " + "long words " * 40]
    data, offsets = column_bytes(pa.array([t.lower() for t in texts]))
    w = toxicity.sentence_windows(data, offsets)
    z = toxicity.landmark_features(["one two", "long words", "three", "ü é l"])
    x = toxicity.window_features(w, z)
    weights = np.random.default_rng(2).normal(size=x.shape[1])
    got = toxicity.window_margins(w, (z.project @ weights).astype(np.float32)[z.place], 0.25)
    assert np.allclose(got, x @ weights + 0.25, atol=1e-3)
    assert w.row[:2].tolist() == [0, 0] and (w.row == 4).sum() == 4
    for k, s in enumerate(["one two.", "three!"]):
        assert np.allclose(x[k], toxicity.nystrom([s], z)[0], atol=1e-4)


def test_toxicity_of_letters_beyond_ascii_spelt_with_spaces():
    m = toxicity.train([(t.replace("zombick", "дуралей"), y) for t, y in toy()])
    m.sentence = None
    word = toxicity.fragment_margins(toxicity.joined(["дуралей"]), 1, m)[0]
    assert features(m, "д у р а л е й")[0, toxicity.WORST] == pytest.approx(word) and features(m, "nasa д у р а л е й tonu")[0, toxicity.WORST] >= word - 1e-9


def test_all_clean_words_are_held_against_the_machine(monkeypatch):
    monkeypatch.setattr(toxicity, "NEGATIVES", 5)  # the words learnt from first are few
    rng = random.Random(4)
    rows = toy() + [(" ".join("zom" + "".join(rng.choice("aeiou") + rng.choice("lnrst") for _ in range(3)) for _ in range(40)), 0) for _ in range(30)]
    clean = sorted(toxicity.contexts([t for t, y in rows if not y])[0])
    learnt: list[str] = []
    inner = toxicity.nystrom
    monkeypatch.setattr(toxicity, "nystrom", lambda fragments, z: learnt.extend(fragments) or inner(fragments, z))
    weights, bias, _ = toxicity.fragment_machine(rows, np.random.default_rng(5))
    score = toxicity.fragment_margins(toxicity.joined(clean), len(clean), toxicity.plain_model(weights, bias))
    assert {f for f, s in zip(clean, score, strict=True) if s > -0.8} <= set(learnt)
