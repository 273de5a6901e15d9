"""Queries over the corpus: scans, chunks, sections, duplicates, parity, normal forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import notice as N
from tessera.functions import text as T
from tessera.operators import chunk, html, integrity, phrases, tokenwindows
from tessera.sources import manifest, sinks, tables

from .common import read, squeeze_sql, tokens_sql

def markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as Markdown (doc, line, text): the tables hold none, so every fourth line, counted from the id, becomes a heading of a level that the two give, and every eleventh a fence."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    k = F.col("doc") + F.col("line")
    head = F.concat(F.repeat(F.lit("#"), (k % 6 + 1).cast("int")), F.lit(" "), "raw")
    return docs.select("doc", "line", F.when(k % 11 == 0, F.when(k % 5 < 3, F.lit("```")).otherwise(F.lit("~~~"))).when(k % 4 == 0, head).otherwise(F.col("raw")).alias("text"))


def _values(rows: list[tuple], columns: str) -> str:
    def lit(v) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({columns})"


MD_SQL = """
lines AS (SELECT doc, line, CASE WHEN (doc + line) % 11 = 0 THEN CASE WHEN (doc + line) % 5 < 3 THEN '```' ELSE '~~~' END
    WHEN (doc + line) % 4 = 0 THEN repeat('#', ((doc + line) % 6 + 1)::INT) || ' ' || raw ELSE raw END AS text
  FROM (SELECT doc_id AS doc, (generate_subscripts(l, 1) - 1)::INT AS line, unnest(l) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)))
"""
# which fence is open after each marker of a document: a fold over its markers (1: ```, 2: ~~~, 0: none open)
FENCE_SQL = rf"""
{MD_SQL.strip()},
marks AS (SELECT *, CASE regexp_extract(text, '^ {{0,3}}(```|~~~)', 1) WHEN '```' THEN '1' WHEN '~~~' THEN '2' END AS mark FROM lines),
folds AS (SELECT doc, list_reduce(list(mark ORDER BY line), lambda s, m: s || CASE WHEN s[-1] = '0' THEN m WHEN s[-1] = m THEN '0' ELSE s[-1] END, '0') AS states FROM marks WHERE mark IS NOT NULL GROUP BY doc),
counted AS (SELECT *, coalesce(count(mark) OVER (PARTITION BY doc ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM marks),
state AS (SELECT c.doc, c.line, c.text, coalesce(substr(f.states, before + 1, 1), '0') <> '0' OR mark IS NOT NULL AS in_fence FROM counted c LEFT JOIN folds f ON c.doc = f.doc)
"""


def visible_sql(x: str) -> str:
    """``visible_markdown`` as DuckDB writes it."""
    x = rf"regexp_replace(regexp_replace({x}, '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '<[^>]+>', ' ', 'g')"
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{sign}')"
    return squeeze_sql(f"regexp_replace({x}, '`|\\*\\*|__', '', 'g')")


SECTION_SQL = rf"""
{FENCE_SQL.strip()},
free AS (SELECT doc, line, text FROM state WHERE NOT in_fence),
ev AS (SELECT doc, line, length(regexp_extract(text, '^(#{{1,6}})[ \t]+\S', 1)) AS level,
    {visible_sql(squeeze_sql(r"regexp_replace(regexp_replace(text, '^#{1,6}[ \t]+', ''), '[ \t]+#+[ \t]*$', '')"))} AS heading FROM free),
h AS (SELECT * FROM ev WHERE level > 0),
p AS (SELECT *, lead(line) OVER (PARTITION BY doc ORDER BY line) AS next_line,
    {", ".join(f"last_value(CASE WHEN level <= {k} THEN {{'lv': level, 'hd': heading}} END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a{k}" for k in range(2, 6))}
  FROM h),
paths AS (SELECT doc, line, level, heading, next_line, list_filter([{", ".join(f"CASE WHEN a{k}.lv = {k} AND level > {k} THEN a{k}.hd END" for k in range(2, 6))}, heading], lambda x: x IS NOT NULL) AS heading_path FROM p WHERE level > 1),
bod AS (SELECT p.doc, p.level, p.heading, p.heading_path, p.line AS first_line, max(l.line) AS last_line,
    {squeeze_sql("string_agg(l.text, chr(10) ORDER BY l.line)")} AS body
  FROM paths p JOIN lines l ON l.doc = p.doc AND l.line > p.line AND (p.next_line IS NULL OR l.line < p.next_line) GROUP BY ALL),
secs AS (SELECT *, (row_number() OVER (PARTITION BY doc ORDER BY first_line) - 1)::INT AS section_index FROM bod WHERE body <> '')
"""


def corpus_scan_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return manifest.validate(docs, "doc_id", ["text", "lang", "source"], {"lang": ["en", "fr", "de", "es"], "source": None}, {"source": r"^src[0-9]+$"})


CORPUS_SCAN_SQL = f"""
SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids, count(*) = count(DISTINCT doc_id) AS ids_unique,
  count_if({squeeze_sql("text")} = '') AS blank_text, count_if({squeeze_sql("lang")} = '') AS blank_lang, count_if({squeeze_sql("source")} = '') AS blank_source,
  count_if(coalesce(lower(lang) NOT IN ('en','fr','de','es'), true)) AS bad_lang,
  count_if(coalesce(NOT regexp_matches(source, '^src[0-9]+$'), true)) AS bad_source
FROM documents
"""

CHUNK_SQL = f"""
tk AS (SELECT doc_id, {tokens_sql("text")} AS t FROM documents),
n AS (SELECT *, len(t) AS n, CASE WHEN len(t) = 0 THEN 0 WHEN len(t) <= 220 THEN 1 ELSE ceil((len(t) - 220) / 180.0)::INT + 1 END AS k FROM tk),
w AS (SELECT doc_id, t, n, unnest(range(0, k))::INT AS ordinal FROM n),
ch AS (SELECT doc_id, ordinal, ordinal * 180 AS token_start, least(ordinal * 180 + 220, n)::INT AS token_end, array_to_string(t[ordinal * 180 + 1 : ordinal * 180 + 220], ' ') AS chunk_text FROM w),
chunks AS (SELECT doc_id, ordinal, token_start, token_end, token_end - token_start AS token_count, chunk_text, sha256(chunk_text) AS text_sha256 FROM ch)
"""


def chunk_fixed_220_40(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunk.fixed_chunks(read(spark, sf_dir, "documents"))
    return c.select("doc_id", "ordinal", "token_start", "token_end", "token_count", "text_sha256", "chunk_id")


def chunk_tokens_220_40(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of at most 220 tokens of a tokenizer file."""
    c = tokenwindows.token_chunks(read(spark, sf_dir, "documents"), tokenwindows.default_path())
    return c.select("doc_id", "ordinal", "token_start", "token_end", "token_count", "exact", "text_sha256", "chunk_id")


def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each document's fields as JSON with sorted keys and no spaces."""
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", T.sha256(T.canonical_json(["source", "doc_id", "lang", "n_chars"])).alias("json_sha256"))


CANONICAL_SQL = """
SELECT doc_id, sha256('{"doc_id":' || coalesce(doc_id::VARCHAR, 'null') || ',"lang":' || coalesce('"' || lang || '"', 'null') || ',"n_chars":' || coalesce(n_chars::VARCHAR, 'null') || ',"source":' || coalesce('"' || source || '"', 'null') || '}') AS json_sha256 FROM documents
"""


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.size(T.whitespace_tokens(F.col("text"))).alias("n"), "lang")
    k = docs.withColumn("k", chunk.window_count(F.col("n")))
    rows = k.groupBy("lang", "k").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"))
    w = W.partitionBy("lang").orderBy("k")
    upto = F.sum("docs").over(w)
    total = F.sum("docs").over(W.partitionBy("lang"))
    ranked = rows.select("lang", "k", "docs", "tokens", upto.alias("upto"), total.alias("total"))
    rank = F.ceil(F.lit(0.95) * F.col("total"))
    return ranked.groupBy("lang").agg(
        F.sum("docs").alias("documents"), F.sum(F.col("k") * F.col("docs")).alias("chunks"), F.sum("tokens").alias("tokens"),
        F.min("k").alias("min_chunks"), F.max("k").alias("max_chunks"), F.min(F.when(F.col("upto") >= rank, F.col("k"))).alias("p95_chunks"),
        ((F.min(F.when(2 * F.col("upto") >= F.col("total"), F.col("k"))) + F.min(F.when(2 * F.col("upto") >= F.col("total") + F.when(F.col("total") % 2 == 0, 2).otherwise(1), F.col("k")))) / 2).alias("median_chunks"),
    )


CHUNK_STATS_SQL = f"""
WITH {CHUNK_SQL}
SELECT d.lang, count(*) AS documents, sum(n.k)::BIGINT AS chunks, sum(n.n)::BIGINT AS tokens, min(n.k)::INT AS min_chunks, max(n.k)::INT AS max_chunks,
  list_sort(list(n.k))[ceil(0.95 * count(*))::INT]::INT AS p95_chunks, median(n.k) AS median_chunks
FROM n JOIN documents d USING (doc_id) GROUP BY d.lang
"""


def chunk_overlap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunk.fixed_chunks(read(spark, sf_dir, "documents")).select("doc_id", "ordinal", "token_start", "token_end")
    w = W.partitionBy("doc_id").orderBy("ordinal")
    c = c.select("*", F.lag("token_end").over(w).alias("before"), (F.row_number().over(w) - 1).alias("place"))
    return c.agg(F.count(F.lit(1)).alias("chunks"), F.count_if((F.col("before").isNotNull()) & (F.col("token_start") != F.col("before") - 40)).alias("bad_overlaps"), F.count_if(F.col("place") != F.col("ordinal")).alias("bad_ordinals"))


CHUNK_OVERLAP_SQL = f"""
WITH {CHUNK_SQL}, g AS (SELECT *, lag(token_end) OVER w AS before, row_number() OVER w - 1 AS place FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal))
SELECT count(*) AS chunks, count_if(before IS NOT NULL AND token_start <> before - 40) AS bad_overlaps, count_if(place <> ordinal) AS bad_ordinals FROM g
"""


def chunk_registry_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry written as JSON lines and read back with its schema, row by row against what its fields must be."""
    c = chunk.fixed_chunks(read(spark, sf_dir, "documents"))
    path = f"{tables.shared_dir(spark)}/tessera/registry-{uuid.uuid4().hex}"
    sinks.write_jsonl(c, path, ["doc_id", "ordinal"])
    c = manifest.read_jsonl(spark, path, c.schema)
    bad = {
        "bad_hash": T.sha256(F.col("chunk_text")) != F.col("text_sha256"),
        "bad_count": ~F.col("token_count").between(1, 220),
        "bad_span": F.col("token_end") <= F.col("token_start"),
        "bad_id": ~F.col("chunk_id").rlike("^-?[0-9]+__fixed_220_40__[0-9]{6,}__[0-9a-f]{64}$") | (F.substring_index("chunk_id", "__", -1) != F.col("text_sha256")) | (F.substring_index("chunk_id", "__", 1) != F.col("doc_id").cast("string")),
    }
    return c.groupBy(F.pmod("doc_id", F.lit(20)).alias("part")).agg(F.count(F.lit(1)).alias("chunks"), *(F.count_if(p).alias(k) for k, p in bad.items()))


CHUNK_CONSTRAINTS_SQL = f"""
WITH {CHUNK_SQL}
SELECT ((doc_id % 20) + 20) % 20 AS part, count(*) AS chunks, count_if(sha256(chunk_text) <> text_sha256) AS bad_hash, count_if(token_count NOT BETWEEN 1 AND 220) AS bad_count,
  count_if(token_end <= token_start) AS bad_span, count_if(NOT regexp_full_match(printf('%s__fixed_220_40__%06d__%s', doc_id::VARCHAR, ordinal, sha256(chunk_text)), '-?[0-9]+__fixed_220_40__[0-9]{{6,}}__[0-9a-f]{{64}}')
    OR split_part(printf('%s__fixed_220_40__%06d__%s', doc_id::VARCHAR, ordinal, sha256(chunk_text)), '__', 4) <> text_sha256) AS bad_id FROM chunks GROUP BY 1
"""


def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.sections(markdown_lines(spark, sf_dir)).withColumn("heading_path", F.array_join("heading_path", " > "))


def heading_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunk.section_chunks(chunk.sections(markdown_lines(spark, sf_dir)))
    return c.select("doc", "section_index", "subchunk_index", "token_start", "token_end", "token_count", "text_sha256", "chunk_id")


HEADING_CHUNKS_SQL = f"""
WITH {SECTION_SQL},
tk AS (SELECT doc, section_index, heading_path, {tokens_sql("body")} AS t FROM secs),
w AS (SELECT *, unnest(range(0, CASE WHEN len(t) <= 220 THEN 1 ELSE ceil((len(t) - 220) / 180.0)::INT + 1 END))::INT AS i FROM tk),
c AS (SELECT doc, section_index, i AS subchunk_index, i * 180 AS token_start, least(i * 180 + 220, len(t))::INT AS token_end,
  doc || chr(10) || array_to_string(heading_path, ' > ') || chr(10) || chr(10) || array_to_string(t[i * 180 + 1 : i * 180 + 220], ' ') AS x FROM w)
SELECT doc, section_index, subchunk_index, token_start, token_end, token_end - token_start AS token_count, sha256(x) AS text_sha256,
  printf('%s__heading_220_40__s%04d__c%04d__%s', doc::VARCHAR, section_index, subchunk_index, sha256(x)) AS chunk_id FROM c
"""


def section_token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section's span in its document's token sequence."""
    return chunk.section_offsets(markdown_lines(spark, sf_dir))


SECTION_OFFSETS_SQL = f"""
WITH {SECTION_SQL}, c AS (SELECT doc, line, len({tokens_sql("text")}) AS n FROM lines),
t AS (SELECT *, sum(n) OVER (PARTITION BY doc ORDER BY line) - n AS start FROM c)
SELECT s.doc, s.section_index, min(t.start)::BIGINT AS token_start, max(t.start + t.n)::BIGINT AS token_end
FROM secs s JOIN t ON t.doc = s.doc AND t.line BETWEEN s.first_line + 1 AND s.last_line GROUP BY ALL
"""


def code_fence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.fence_state(markdown_lines(spark, sf_dir))


def chunk_section_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and synthetic sections of 100 tokens: overlaps of all documents, by document."""
    docs = read(spark, sf_dir, "documents")
    c = chunk.fixed_chunks(docs).select("doc_id", "ordinal", "token_start", "token_end")
    n = docs.select("doc_id", F.size(T.whitespace_tokens(F.col("text"))).alias("n")).where("n > 0")
    spans = n.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 100).cast("int"))).alias("section"))
    spans = spans.select("doc_id", "section", (F.col("section") * 100).alias("span_start"), F.least(F.col("section") * 100 + 100, "n").alias("span_end"))
    return chunk.overlap_join(c, spans).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum("overlap").alias("overlap_tokens"), F.max("overlap").alias("longest"))


CHUNK_SECTION_SQL = f"""
WITH {CHUNK_SQL}, sp AS (SELECT doc_id, n, unnest(range(0, (n - 1) // 100 + 1))::INT AS s FROM n WHERE n > 0),
spans AS (SELECT doc_id, s * 100 AS a, least(s * 100 + 100, n) AS b FROM sp)
SELECT c.doc_id, count(*) AS pairs, sum(least(token_end, b) - greatest(token_start, a))::BIGINT AS overlap_tokens, max(least(token_end, b) - greatest(token_start, a))::INT AS longest
FROM chunks c JOIN spans s ON c.doc_id = s.doc_id AND token_start < b AND a < token_end GROUP BY c.doc_id
"""


def duplicate_docs_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.duplicate_groups(read(spark, sf_dir, "documents").where("text is not null"), F.col("text"))


def duplicate_docs_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.duplicate_groups(read(spark, sf_dir, "documents"), integrity.body_only(F.col("text")))


def duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all groups of equal texts: digest, doc_id."""
    return integrity.duplicate_members(read(spark, sf_dir, "documents").where("text is not null"), F.col("text"))


def idset_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return integrity.set_digest(docs, "source", F.concat_ws(":", F.col("doc_id").cast("string"), T.sha256(F.col("text"))))


def ordered_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each source's sorted lines "id  sha256 of the text": of 256 blocks by the id's rest, then of the blocks' digests."""
    docs = read(spark, sf_dir, "documents").where("text is not null")
    line = F.concat_ws("  ", F.format_string("%012d", "doc_id"), T.sha256(F.col("text")))
    return integrity.ordered_digest(docs, "source", line, F.pmod("doc_id", F.lit(256)))


def frozen_input_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of all sources pinned, and compared after the row of doc_id 0 has changed: pinned, changed, lost, new."""
    docs = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", "source", "text")
    line = F.concat_ws("  ", F.format_string("%012d", "doc_id"), T.sha256(F.col("text")))
    pins = tables.written(integrity.ordered_digest(docs, "source", line, F.pmod("doc_id", F.lit(256))), "pins")
    now = integrity.ordered_digest(docs.withColumn("text", F.when(F.col("doc_id") == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))), "source", line, F.pmod("doc_id", F.lit(256)))
    return integrity.gate(pins, now, "source")


def frozen_rows_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of documents pinned, and compared after doc_id 7 has changed, every 100th from 50 on is gone and doc_id -1 is new: doc_id and what became of it."""
    digest = T.sha256(F.concat_ws("\n", F.coalesce("source", F.lit("")), F.coalesce("text", F.lit("")))).alias("digest")
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "source", "text")
    pins = tables.written(docs.select("key", digest).sortWithinPartitions("key"), "pins")
    now = docs.where("key % 100 <> 50").withColumn("text", F.when(F.col("key") == 7, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))
    now = now.select("key", digest).unionByName(spark.sql("select -1L as key, 'new' as digest"))
    return integrity.changed_rows(pins, tables.written(now, "now")).select(F.col("key").alias("doc_id"), "status")


def idset_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.parity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id")


def file_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected files (one per document) against those there are (one per label), by status."""
    name = F.format_string("doc_%08d.md", "doc_id").alias("name")
    p = integrity.parity(read(spark, sf_dir, "documents").select(name), read(spark, sf_dir, "labels").select(name), "name")
    return p.groupBy("side").agg(F.count(F.lit(1)).alias("files"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))


def required_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("lang", "source").distinct()
    # every language with every source: as many rows as languages times sources, however many documents
    required = docs.select("lang").distinct().crossJoin(docs.select("source").distinct().unionByName(spark.sql("select 'srcX' as source")))
    return integrity.coverage(required, docs, "lang", "source").withColumn("missing_items", F.array_join("missing_items", ","))


def token_multiset_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each page's article words its Markdown keeps."""
    pages = html.markdown(read(spark, sf_dir, "pages"))
    raw = pages.select("page_id", F.explode(T.search_tokens(F.col("article_text"))).alias("token"))
    kept = pages.select("page_id", F.explode(T.search_tokens(T.visible_markdown(F.col("markdown")))).alias("token"))
    return integrity.multiset_coverage(raw, kept, "page_id", "token")


def document_token_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document's words its text without repeated lines keeps."""
    docs = read(spark, sf_dir, "documents").where("text is not null")
    once = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")  # lines go as a whole, so its words are a part of the text's
    return integrity.kept_coverage(docs, "doc_id", T.whitespace_tokens(F.col("text")), T.whitespace_tokens(once))


DOC_COVERAGE_SQL = f"""
WITH once AS (SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda x: list_position(l, x[1]) = x[2]), lambda x: x[1]), chr(10)) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
a AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({tokens_sql("text")}) AS token FROM documents) GROUP BY ALL),
b AS (SELECT doc_id, token, count(*) AS m FROM (SELECT doc_id, unnest({tokens_sql("text")}) AS token FROM once) GROUP BY ALL)
SELECT a.doc_id, sum(n)::BIGINT AS raw_tokens, sum(least(n, coalesce(m, 0)))::BIGINT AS shared, round(sum(least(n, coalesce(m, 0)))::DOUBLE / sum(n), 6) AS share
FROM a LEFT JOIN b ON a.doc_id = b.doc_id AND a.token = b.token GROUP BY a.doc_id
"""


def quote_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which benchmark passages stand in which documents, white space aside (at least 20 characters and 4 words)."""
    quotes = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("phrase_id"), T.squeeze(F.col("text")).alias("phrase"))
    quotes = quotes.where((F.length("phrase") >= 20) & (F.size(F.split("phrase", " ")) >= 4))
    docs = read(spark, sf_dir, "documents").select("doc_id", T.squeeze(F.col("text")).alias("body"))
    found = phrases.contained(docs, quotes, "doc_id", "body")
    return found.select(F.col("phrase_id").alias("item_id"), "doc_id", F.length("phrase").alias("quote_chars"))


QUOTE_SQL = f"""
WITH q AS (SELECT item_id, {squeeze_sql("text")} AS quote FROM benchmark), d AS (SELECT doc_id, {squeeze_sql("text")} AS body FROM documents)
SELECT item_id, doc_id, length(quote)::INT AS quote_chars FROM q JOIN d ON contains(body, quote) WHERE length(quote) >= 20 AND len(string_split(quote, ' ')) >= 4
"""


def quality_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("lines", F.size(F.split("text", "\n"))).withColumn("words", F.size(T.whitespace_tokens(F.col("text"))))
    return docs.agg(
        F.count(F.lit(1)).alias("documents"), F.count("text").alias("with_text"), F.count_if(F.length("text") != F.col("n_chars")).alias("length_mismatch"),
        F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"), F.sum("words").alias("words"), F.sum("lines").alias("lines"),
        F.count_if(F.col("words") < 20).alias("short"), F.count_if(F.contains("text", F.lit("http"))).alias("with_link"), F.bool_and(F.col("doc_id").isNotNull()).alias("all_ids"),
    )


QUALITY_ROLLUP_SQL = f"""
SELECT count(*) AS documents, count(text) AS with_text, count_if(length(text) <> n_chars) AS length_mismatch, min(n_chars) AS min_chars, max(n_chars) AS max_chars,
  sum(len({tokens_sql("text")}))::BIGINT AS words, sum(len(string_split(text, chr(10))))::BIGINT AS lines, count_if(len({tokens_sql("text")}) < 20) AS short,
  count_if(contains(text, 'http')) AS with_link, bool_and(doc_id IS NOT NULL) AS all_ids FROM documents
"""


def redact_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", N.redact(F.col("text")).alias("r"))
    return docs.select("doc_id", T.sha256(F.col("r")).alias("redacted_sha256"), F.regexp_count("r", F.lit(r"\[REDACTED")).alias("redactions"))


def whitespace_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", T.preview(F.col("text"), 360).alias("preview_360"), T.preview(F.col("text"), 420).alias("preview_420"))


WHITESPACE_SQL = f"SELECT doc_id, substr({squeeze_sql('text')}, 1, 360) AS preview_360, substr({squeeze_sql('text')}, 1, 420) AS preview_420 FROM documents"


def unicode_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", T.sha256(T.nfc(F.col("text"))).alias("nfc_sha256"), T.sha256(T.nfc_squeeze(F.col("text"))).alias("nfc_squeezed_sha256"))


UNICODE_SQL = rf"""
SELECT doc_id, sha256(nfc_normalize(text)) AS nfc_sha256, sha256(trim(regexp_replace(nfc_normalize(text), '[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+', ' ', 'g'))) AS nfc_squeezed_sha256 FROM documents
"""


def unicode_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", T.sha256(T.nfkc_clean(F.col("text"))).alias("nfkc_sha256"), T.sha256(T.casefold(F.col("text"))).alias("folded_sha256"))


URLS = ["https://example.org/a/", "http://example.org/a", "https://user@example.org/a", "https://example.org:8443/a", "HTTPS://EXAMPLE.org/a?x=1"]


def url_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages are https on an allowed site, without user and odd port, and the key that equal sources share."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return pages.select("page_id", *manifest.url_parts(F.col("url"), ["example.com", "example.org"]))


URL_SQL = r"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS auth,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages),
h AS (SELECT *, contains(auth, '@') AS has_user, lower(regexp_replace(regexp_replace(auth, '^.*@', ''), ':[0-9]*$', '')) AS host, regexp_extract(auth, ':([0-9]+)$', 1) AS port FROM p)
SELECT page_id, host, (scheme = 'https' AND NOT has_user AND port IN ('', '443') AND (regexp_matches(host, '(^|\.)example\.com$') OR regexp_matches(host, '(^|\.)example\.org$'))) AS allowed,
  sha256(scheme || chr(10) || host || chr(10) || rtrim(path, '/') || chr(10) || query) AS source_key FROM h
"""


def notebook_family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("documents")).orderBy(F.desc("documents"), "source")


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.blocks(read(spark, sf_dir, "pages"))


def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.markdown(read(spark, sf_dir, "pages")).select("page_id", "title", "markdown", "n_blocks")


def html_quality_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.problems(html.markdown(read(spark, sf_dir, "pages")))


def visible_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(VISIBLE)], "case_id int, text string")
    return rows.select("case_id", T.visible_markdown(F.col("text")).alias("visible"), T.repair_extraction(F.col("text")).alias("repaired"))


VISIBLE = ["[A label](https://example.org) and **bold** text", "x <br> y &amp; z", "`code` __under__  spaced", "Noti \n ce CP14 A mount due", ""]
VISIBLE_SQL = f"""
WITH v AS (SELECT * FROM {_values([(i, x) for i, x in enumerate(VISIBLE)], "case_id, text")}),
a AS (SELECT case_id, text, regexp_replace(regexp_replace(text, '!?\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '<[^>]+>', ' ', 'g') AS t FROM v)
SELECT case_id, {squeeze_sql("regexp_replace(replace(t, '&amp;', '&'), '`|\\*\\*|__', '', 'g')")} AS visible,
  {squeeze_sql("regexp_replace(regexp_replace(text, '(?i)Noti\\s*\\n\\s*ce', 'Notice', 'g'), '(?i)A\\s+mount', 'Amount', 'g')")} AS repaired FROM a
"""


QUERIES = {
    f.__name__: f
    for f in (
        corpus_scan_validated, chunk_fixed_220_40, chunk_tokens_220_40, canonical_json, chunk_stats, chunk_overlap_check, chunk_registry_constraints, heading_sections, heading_chunks, section_token_offsets,
        code_fence_state, chunk_section_overlap, duplicate_docs_exact, duplicate_docs_body, duplicate_members, idset_digest, ordered_digest, frozen_input_gate, frozen_rows_gate, idset_parity, file_reconciliation, required_coverage,
        token_multiset_coverage, document_token_coverage, quote_containment, quality_rollup, redact_pii, whitespace_preview, unicode_normalize, unicode_clean,
        url_allowlist, notebook_family_counts, html_blocks, html_markdown, html_quality_problems, visible_markdown,
    )
}

DIGEST_SQL = "WITH l AS (SELECT source, doc_id, printf('%012d', doc_id) || '  ' || sha256(text) AS line FROM documents WHERE text IS NOT NULL), b AS (SELECT source, ((doc_id % 256) + 256) % 256 AS part, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY line)) AS h FROM l GROUP BY ALL), t AS (SELECT source, sum(n)::BIGINT AS n, sha256(string_agg(h, chr(10) ORDER BY part)) AS digest FROM b GROUP BY source)"
DUP = "SELECT sha256({0}) AS digest, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents {1} GROUP BY 1 HAVING count(*) > 1"

SQL = {
    "canonical_json": CANONICAL_SQL,
    "corpus_scan_validated": CORPUS_SCAN_SQL,
    "chunk_fixed_220_40": f"WITH {CHUNK_SQL} SELECT doc_id, ordinal, token_start, token_end, token_count, text_sha256, printf('%s__fixed_220_40__%06d__%s', doc_id::VARCHAR, ordinal, text_sha256) AS chunk_id FROM chunks",
    "chunk_stats": CHUNK_STATS_SQL,
    "chunk_overlap_check": CHUNK_OVERLAP_SQL,
    "chunk_registry_constraints": CHUNK_CONSTRAINTS_SQL,
    "heading_sections": f"WITH {SECTION_SQL} SELECT doc, level::INT AS level, heading, array_to_string(heading_path, ' > ') AS heading_path, first_line, last_line, body, section_index FROM secs",
    "heading_chunks": HEADING_CHUNKS_SQL,
    "section_token_offsets": SECTION_OFFSETS_SQL,
    "chunk_section_overlap": CHUNK_SECTION_SQL,
    "duplicate_docs_exact": DUP.format("text", "WHERE text IS NOT NULL"),
    "duplicate_docs_body": DUP.format("trim(array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT (starts_with(x, '# ') OR starts_with(x, 'Source: '))), chr(10)))", ""),
    "code_fence_state": f"WITH {FENCE_SQL} SELECT doc, line, text, in_fence FROM state",
    "duplicate_members": "SELECT sha256(text) AS digest, doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)",
    "idset_digest": "WITH h AS (SELECT source, sha256(doc_id::VARCHAR || ':' || sha256(text)) AS h FROM documents) SELECT source, count(*) AS n, sha256(count(*)::VARCHAR || ':' || sum(('0x' || substr(h, 1, 15))::HUGEINT)::VARCHAR || ':' || sum(('0x' || substr(h, 16, 15))::HUGEINT)::VARCHAR || ':' || sum(('0x' || substr(h, 31, 15))::HUGEINT)::VARCHAR || ':' || sum(('0x' || substr(h, 46, 15))::HUGEINT)::VARCHAR) AS digest FROM h GROUP BY source",
    "ordered_digest": DIGEST_SQL + " SELECT source, n, digest FROM t",
    "frozen_input_gate": DIGEST_SQL + ", c AS (SELECT DISTINCT source FROM documents WHERE doc_id = 0 AND text IS NOT NULL) SELECT count(*) AS pinned, (SELECT count(*) FROM c) AS changed, 0::BIGINT AS lost, 0::BIGINT AS added, coalesce((SELECT string_agg(coalesce(source, 'null'), ',' ORDER BY source) FROM c), '') AS changed_ids FROM t",
    "frozen_rows_gate": "SELECT doc_id, 'changed' AS status FROM documents WHERE doc_id = 7 UNION ALL SELECT doc_id, 'lost' FROM documents WHERE doc_id % 100 = 50 UNION ALL SELECT -1, 'added'",
    "idset_parity": "SELECT doc_id, 'missing' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'extra' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)",
    "file_reconciliation": "WITH a AS (SELECT printf('doc_%08d.md', doc_id) AS name FROM documents), b AS (SELECT printf('doc_%08d.md', doc_id) AS name FROM labels), p AS (SELECT name, 'missing' AS side FROM (SELECT name FROM a EXCEPT SELECT name FROM b) UNION ALL SELECT name, 'extra' FROM (SELECT name FROM b EXCEPT SELECT name FROM a)) SELECT side, count(*) AS files, min(name) AS first_name, max(name) AS last_name FROM p GROUP BY side",
    "required_coverage": "WITH d AS (SELECT DISTINCT lang, source FROM documents), r AS (SELECT * FROM (SELECT DISTINCT lang FROM d), (SELECT DISTINCT source FROM d UNION ALL SELECT 'srcX')) SELECT r.lang, count(*) AS required, count(d.source) AS present, count(*) - count(d.source) AS missing, coalesce(string_agg(CASE WHEN d.source IS NULL THEN r.source END, ',' ORDER BY r.source), '') AS missing_items FROM r LEFT JOIN d ON r.lang = d.lang AND r.source = d.source GROUP BY r.lang",
    "document_token_coverage": DOC_COVERAGE_SQL,
    "quote_containment": QUOTE_SQL,
    "quality_rollup": QUALITY_ROLLUP_SQL,
    "whitespace_preview": WHITESPACE_SQL,
    "unicode_normalize": UNICODE_SQL,
    "url_allowlist": URL_SQL,
    "notebook_family_counts": "SELECT source, count(*) AS documents FROM documents GROUP BY source",
    "visible_markdown": VISIBLE_SQL,
}
