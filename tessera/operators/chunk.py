"""Chunking: fixed token windows, heading sections and their intersections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources import tables

from . import scan

SIZE, OVERLAP = 220, 40


def window_count(n: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Windows over n tokens: the last one ends at the end and none holds only overlap."""
    return F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / (size - overlap)) + 1).cast("int")


def windows(rows: DataFrame, tokens: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """One row per window: ordinal, token_start, token_end, token_count, chunk_text; ``tokens`` is dropped."""
    n = F.size(tokens)
    k = window_count(n, size, overlap)
    each = F.explode(F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>")))
    start = F.col("ordinal") * (size - overlap)
    out = rows.withColumn("ordinal", each).withColumn("token_start", start).withColumn("token_end", F.least(start + size, n))
    part = F.slice(F.col(tokens), F.col("token_start") + 1, F.lit(size))
    return out.withColumn("token_count", F.col("token_end") - F.col("token_start")).withColumn("chunk_text", F.array_join(part, " ")).drop(tokens)


def fixed_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks of fixed size of whole documents with ids from their content. Null texts are empty and have none."""
    base = docs.select(F.col(doc_id).alias("doc_id"), T.whitespace_tokens(F.col(text)).alias("tokens"))
    out = windows(base, "tokens").withColumn("text_sha256", T.sha256(F.col("chunk_text")))
    return out.withColumn("chunk_id", T.chunk_id(F.col("doc_id"), "fixed_220_40", F.col("ordinal"), F.col("text_sha256")))


def fence_state(lines: DataFrame, doc: str = "doc", line: str = "line", text: str = "text", held: list[DataFrame] | None = None) -> DataFrame:
    """Lines of Markdown with ``in_fence`` (inside or delimiting a code fence); a fence closes with its own marker only.

    A marker is a map between what may be open before and after it, and maps compose, so the
    states are a segmented scan: linear in the lines, and a long document is many tasks.
    """
    marker = F.nullif(F.regexp_extract(text, r"^ {0,3}(```|~~~)", 1), F.lit(""))
    before = scan.scan(lines, doc, line, marker, scan.FENCES, "_open", held)
    return before.withColumn("in_fence", (F.col("_open") != "") | marker.isNotNull()).drop("_open")


def heading_lines(lines: DataFrame, held: list[DataFrame] | None = None) -> DataFrame:
    """Lines (doc, line, text) with level and heading, null where a line is no ATX heading outside of fences; heading_path: the open headings above it and its own; under: the line of the last heading before it.

    An H1 clears the path and is not part of it; levels may be skipped.
    """
    level = F.length(F.regexp_extract("text", r"^(#{1,6})[ \t]+\S", 1))
    title = T.squeeze(F.regexp_replace(F.regexp_replace("text", r"^#{1,6}[ \t]+", ""), r"[ \t]+#+[ \t]*$", ""))
    fences: list[DataFrame] = []
    rows = fence_state(lines.select("doc", "line", "text"), held=fences).withColumn("level", F.when(~F.col("in_fence") & (level > 0), level))
    rows = rows.withColumn("heading", F.when(F.col("level").isNotNull(), T.visible_markdown(title)))
    symbol = F.when(F.col("level").isNotNull(), scan.heading_symbol(F.col("level"), F.col("heading"), F.col("line")))
    rows = scan.scan(rows, "doc", "line", symbol, scan.HEADINGS, "_state", held)
    tables.release(*fences)
    rows = rows.withColumn("_state", F.from_json("_state", "line long, open array<string>"))
    above = F.slice(F.col("_state.open"), F.lit(1), F.greatest(F.col("level") - 2, F.lit(0)))
    path = F.array_compact(F.concat(above, F.array(F.when(F.col("level") > 1, F.col("heading")))))
    return rows.withColumn("heading_path", F.when(F.col("level").isNotNull(), path)).withColumn("under", F.col("_state.line")).drop("_state")


def sections(lines: DataFrame) -> DataFrame:
    """Logical sections of lines (doc, line, text), see ``sections_of``."""
    return sections_of(_written_headings(lines))


def _written_headings(lines: DataFrame) -> DataFrame:
    held: list[DataFrame] = []
    rows = tables.written(heading_lines(lines, held), "heading-lines")
    tables.release(*held)
    return rows


def sections_of(rows: DataFrame) -> DataFrame:
    """Logical sections (levels 2 to 6) of ``heading_lines``: doc, section_index, level, heading, heading_path, first_line, last_line, body.

    A section ends at the next heading of any level; sections with an empty body are skipped.
    Each line knows the heading it is under, so bodies are a grouping, not a join by ranges.
    """
    heads = rows.where("level > 1").select("doc", "level", "heading", "heading_path", F.col("line").alias("first_line"))
    body = rows.where("level is null and under is not null").groupBy(F.col("doc").alias("d"), F.col("under").alias("u")).agg(
        F.sort_array(F.collect_list(F.struct("line", "text"))).alias("rows"), F.max("line").alias("last_line")
    )
    text = T.squeeze(F.array_join(F.transform("rows", lambda r: r["text"]), "\n"))
    body = body.select("d", "u", "last_line", text.alias("body")).where("body <> ''")
    full = heads.join(body, F.col("doc").eqNullSafe(F.col("d")) & (F.col("first_line") == F.col("u"))).drop("d", "u")
    return full.withColumn("section_index", F.row_number().over(W.partitionBy("doc").orderBy("first_line")) - 1)


def section_offsets(lines: DataFrame) -> DataFrame:
    """doc, section_index, token_start, token_end: each section's span in its document's token sequence."""
    rows = _written_headings(lines)
    n = F.size(T.whitespace_tokens(F.col("text")))
    before = F.sum(n).over(W.partitionBy("doc").orderBy("line")) - n
    at = rows.select(F.col("doc").alias("d"), "under", "level", n.alias("n"), before.alias("start")).where("level is null and under is not null")
    at = at.groupBy("d", "under").agg(F.min("start").alias("token_start"), F.max(F.col("start") + F.col("n")).alias("token_end"))
    j = sections_of(rows).join(at, F.col("doc").eqNullSafe(F.col("d")) & (F.col("first_line") == F.col("under")))
    return j.select("doc", "section_index", "token_start", "token_end")


def section_chunks(secs: DataFrame) -> DataFrame:
    """Windows within each section; the prefix (document > path) stands outside of the token limit."""
    base = secs.select("doc", "section_index", "heading_path", T.whitespace_tokens(F.col("body")).alias("tokens"))
    out = windows(base, "tokens").withColumnRenamed("ordinal", "subchunk_index")
    prefix = F.concat(F.col("doc").cast("string"), F.lit("\n"), F.array_join("heading_path", " > "), F.lit("\n\n"))
    out = out.withColumn("text", F.concat(prefix, F.col("chunk_text"))).withColumn("text_sha256", T.sha256(F.col("text")))
    return out.withColumn("chunk_id", T.section_chunk_id(F.col("doc"), "heading_220_40", F.col("section_index"), F.col("subchunk_index"), F.col("text_sha256")))


def overlap_join(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """Chunks (doc_id, token_start, token_end) with the spans (doc_id, span_start, span_end) of their document that they overlap; half-open, empty intervals overlap nothing.

    Intervals are put into bins of the mean length of both sides, so each side is not much more
    than doubled, and the join is by document and bin: a document with many spans is many
    keys. A pair is found in the first bin that both are in, and only there.
    """
    c, s = chunks.where("token_start < token_end"), spans.where("span_start < span_end")
    mean = c.agg(F.avg(F.col("token_end") - F.col("token_start")).alias("m")).union(s.agg(F.avg(F.col("span_end") - F.col("span_start")).alias("m"))).agg(F.max("m")).first()[0]
    width = max(1, round(mean or 1))

    def bins(a: str, b: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)))

    s = s.withColumn("s_bin", bins("span_start", "span_end")).withColumnRenamed("doc_id", "s_doc")
    c = c.withColumn("c_bin", bins("token_start", "token_end"))
    meet = (F.col("doc_id") == F.col("s_doc")) & (F.col("c_bin") == F.col("s_bin"))
    first = F.floor(F.greatest("token_start", "span_start") / width) == F.col("c_bin")
    over = F.least("token_end", "span_end") - F.greatest("token_start", "span_start")
    return c.join(s, meet & first & (over > 0)).withColumn("overlap", over).drop("s_doc", "s_bin", "c_bin")
