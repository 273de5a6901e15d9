from __future__ import annotations

import corpus_pipeline as P
from tessera.llm import minhash, packing, tokens, toxicity
from tessera.llm.shared import materialize

SF = "/root/testdata/sf0.01"


def test_stages_take_effect_on_what_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in P.STAGES:
        seen.append(materialize(stage(spark, seen[-1], SF), "test-stage"))
    raw, clean, single, cut, mix, packed = seen
    for df in (clean, single, cut, mix):
        assert df.columns == P.COLUMNS
    model = toxicity.learn(raw, spark.read.parquet(f"{SF}/labels.parquet"))
    score = {r["doc_id"]: r["score"] for r in toxicity.score_texts(raw, model, ["doc_id"]).collect()}
    assert {r["doc_id"] for r in clean.collect()} == {i for i, s in score.items() if s < P.REJECT}
    kept = {r["doc_id"] for r in minhash.near_duplicates(clean).where("kept").collect()}
    assert {r["doc_id"] for r in single.collect()} == kept
    before, after = ({r["doc_id"]: r for r in d.collect()} for d in (single, cut))
    assert before.keys() == after.keys() and all(len(after[i]["text"]) == after[i]["n_chars"] <= len(before[i]["text"]) for i in after)
    assert sum(r["n_chars"] for r in after.values()) < sum(len(r["text"]) for r in before.values())
    times: dict = {}
    for r in mix.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
        assert r["text"] == after[r["doc_id"]]["text"]
    assert times and max(times.values()) <= 3
    pieces = packed.collect()
    assert len([p for p in pieces if p["piece"] == 0]) == sum(times.values())
    encode = tokens.encoder(tokens.default_path())
    total = sum(n * (len(encode(after[i]["text"])) + 1) for i, n in times.items())
    sequences = len({p["sequence_id"] for p in pieces})
    assert sum(p["length"] for p in pieces) == total and sequences <= 1.02 * total / 1024 + 1
    assert packing.EOD == 2
    run = P.run(spark, SF)
    assert run.columns == packed.columns and run.count() == len(pieces)


def test_toxicity_stage_keeps_what_the_operator_predicts_clean(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    clean = {r["doc_id"] for r in toxicity.toxicity(docs, labels).where("predicted = 0").select("doc_id").collect()}
    assert P.REJECT == toxicity.THRESHOLD and {r["doc_id"] for r in P.toxic_out(spark, docs, SF).collect()} == clean
