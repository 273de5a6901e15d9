"""Scans, sections and interval joins against plain folds; long documents over many tasks."""

from __future__ import annotations

import random
import re
import time

import pytest
from oracle import DATA
from pyspark.sql import functions as F

from tessera.operators import chunk, html


@pytest.fixture
def many_tasks(spark):
    """As many tasks as partitions, however few the rows."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def plain_lines(lines):
    """(doc, line) to (in_fence, level, path, under) by one walk through each document."""
    out, doc = {}, object()
    for d, i, text in sorted(lines, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        if d != doc:
            doc, fence, open_, under = d, "", {}, None
        mark = re.match(r" {0,3}(```|~~~)", text)
        inside = bool(fence or mark)
        if mark:
            fence = mark[1] if not fence else "" if fence == mark[1] else fence
        head = None if inside else re.match(r"(#{1,6})[ \t]+(\S.*)", text)
        if head:
            level = len(head[1])
            open_ = {k: v for k, v in open_.items() if k < level}
            if level > 1:
                open_[level] = head[2].strip()
            out[d, i] = (inside, level, [open_[k] for k in sorted(open_) if k > 1], under)
            under = i
        else:
            out[d, i] = (inside, None, None, under)
    return out


def made(seed, n):
    rng = random.Random(seed)
    kinds = ["plain words", "```", "~~~", "# one", "## two", "### three", "#### four", "###### six", "####### none", "#none", "  ``` x", "    ``` no", "words", ""]
    weights = [20, 2, 1, 1, 3, 3, 2, 1, 1, 1, 1, 1, 20, 3]
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None]), i, rng.choices(kinds, weights)[0]) for i in range(n)]
    return [(d, i, f"{t} {i}" if re.match("#+ ", t) else t) for d, i, t in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_headings_and_fences_equal_a_plain_walk(many_tasks, seed):
    """One document with most of the lines, over all tasks; null documents; fences left open."""
    lines = made(seed, 3000)
    rows = chunk.heading_lines(many_tasks.createDataFrame(lines, "doc int, line int, text string")).collect()
    got = {(r["doc"], r["line"]): (r["in_fence"], r["level"], r["heading_path"], r["under"]) for r in rows}
    assert got == plain_lines(lines)


def test_no_lines_and_one(many_tasks):
    for lines in ([], [(1, 0, "## a")], [(1, 0, "x"), (1, 1, "```")]):
        rows = chunk.heading_lines(many_tasks.createDataFrame(lines, "doc int, line int, text string")).collect()
        assert {(r["doc"], r["line"]): (r["in_fence"], r["level"], r["heading_path"], r["under"]) for r in rows} == plain_lines(lines)


def test_time_is_linear_in_fences(spark):
    """A document of 60,000 fence lines: a fold over those before each line would take 1.8 billion steps."""
    lines = spark.range(60_000).select(F.lit(1).alias("doc"), F.col("id").cast("int").alias("line"), F.lit("```").alias("text"))
    began = time.time()
    assert chunk.fence_state(lines).where("in_fence").count() == 60_000
    assert time.time() - began < 60


def test_pages_as_markdown_equal_a_plain_walk(spark):
    """Pages of the given table, whose only headings are their titles, with every fifth line of theirs as a heading."""
    pages = html.markdown(spark.read.parquet(f"{DATA}/pages.parquet")).select("page_id", "markdown").where("markdown is not null").collect()
    lines = [(r["page_id"], i, f"{'#' * (i % 6 + 1)} {t}x" if i % 5 == 4 else t) for r in pages for i, t in enumerate(r["markdown"].split("\n"))]
    rows = chunk.heading_lines(spark.createDataFrame(lines, "doc long, line int, text string")).collect()
    walk = plain_lines(lines)
    assert {(r["doc"], r["line"]): (r["in_fence"], r["level"], r["under"], r["heading_path"] and len(r["heading_path"])) for r in rows} == {k: (f, n, u, p and len(p)) for k, (f, n, p, u) in walk.items()}
    assert sum(n == 1 for _, n, *_ in walk.values()) >= len(pages)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overlaps_equal_all_pairs(spark, seed):
    """Ties, empty, very long and equal intervals."""
    rng = random.Random(seed)

    def some(n):
        return [(rng.choice([1, 1, 2]), k, a, a + rng.choice([0, 1, 5, 20, 700])) for k, a in enumerate(rng.choices(range(300), k=n))]

    a, b = some(60), some(60)
    got = chunk.overlap_join(spark.createDataFrame(a, "doc_id int, ordinal int, token_start int, token_end int"), spark.createDataFrame(b, "doc_id int, section int, span_start int, span_end int"))
    want = [(x[0], x[1], y[1], min(x[3], y[3]) - max(x[2], y[2])) for x in a for y in b if x[0] == y[0] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3]]
    assert sorted((r["doc_id"], r["ordinal"], r["section"], r["overlap"]) for r in got.collect()) == sorted(want)


def test_a_document_of_many_spans(spark):
    """100,000 spans and 55,555 chunks of one document: 155,553 pairs of five billion."""
    spans = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("section"), (F.col("id") * 100).alias("span_start"), (F.col("id") * 100 + 100).alias("span_end"))
    chunks = spark.range(55_555).select(F.lit(1).alias("doc_id"), F.col("id").alias("ordinal"), (F.col("id") * 180).alias("token_start"), (F.col("id") * 180 + 220).alias("token_end"))
    began = time.time()
    want = sum((i * 180 + 219) // 100 - i * 180 // 100 + 1 for i in range(55_555))
    assert chunk.overlap_join(chunks, spans).count() == want
    assert time.time() - began < 60
