"""Every stage of the pipeline on rows that are odd, and on no rows."""

from __future__ import annotations

import corpus_pipeline as P
import pytest

KINDS = "doc_id long, text string, lang string, source string, n_chars long, score int, row string, taken long"
LABELS = "doc_id long, quality int, toxic int"


def rows() -> list[tuple]:
    long = " ".join(f"word{i}" for i in range(40_000))
    odd = [(1, "a few plain words that stand here and nothing else", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (4, " \n\t", None, "s"), (None, "no id at all but some words", "en", None), (5, long, "en", "t"), (6, "tie tie tie", "en", "s"), (6, "tie tie tie", "en", "s")]
    return [(*r, None if r[1] is None else len(r[1]), 1, "x", 7) for r in odd]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (None, None, None)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


@pytest.mark.parametrize(("name", "stage"), P.STAGES)
def test_stage_on_odd_rows(spark, folder, name, stage):
    """Nulls, empty, blank and long texts, repeated rows and further columns with names that the stages use."""
    got = stage(spark, spark.createDataFrame(rows(), KINDS), folder).collect()
    texts = sorted((r[0] is None, r[0] or 0, r[1] or "") for r in rows())
    if name == "packing":
        whole = {}
        for r in got:
            whole.setdefault(r["doc_id"], []).append(r["length"])
        assert whole.keys() == {r[0] for r in rows()} and whole[2] == whole[3] == [1] and len(whole[5]) > 40 and max(whole[5]) == 1024
        return
    have = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in got)
    if name == "mixing":  # documents without words have nothing to take
        assert {t for t in have} <= set(texts) and {r["doc_id"] for r in got} <= {1, 5, 6, None}
    else:  # nothing here is toxic, near another text or a repeat
        assert have == texts


@pytest.mark.parametrize(("name", "stage"), P.STAGES)
def test_stage_on_no_rows(spark, folder, name, stage):
    out = stage(spark, spark.createDataFrame([], KINDS), folder)
    assert out.count() == 0 and (name == "packing" or out.columns == P.COLUMNS)


def test_run_on_odd_rows(spark, folder):
    spark.createDataFrame(rows(), KINDS).write.parquet(f"{folder}/documents.parquet")
    got = P.run(spark, folder).collect()
    assert {r["doc_id"] for r in got} <= {1, 5, 6, None} and 5 in {r["doc_id"] for r in got}
