"""The queries opN_<name> of this package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, embeddings, fingerprint, merkle, minhash, mixing, packing, quality, secret_scan, suffix, tokens, toxicity, url_filter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents covered by 50-byte strings that also start in a smaller document."""
    return suffix.dedup_substrings(_read(spark, sf_dir, "documents"), 50, with_rows=False)


OP1_SQL = r"""
WITH base AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
size AS (SELECT r, doc_id, x, len(x) // 2 AS n FROM base),
parts AS (SELECT r, doc_id, n, p, substr(x, 2 * p + 1, 610) AS x FROM (SELECT *, unnest(range(0, n - 49, 256)) AS p FROM size WHERE n >= 50)),
places AS (SELECT r, doc_id, p + i AS i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(0, least(256, n - 49 - p))) AS i FROM parts)),
least AS (SELECT s, min(doc_id) AS doc_id FROM places GROUP BY s HAVING count(*) > 1),
later AS (SELECT p.r, p.i FROM places p JOIN least l ON p.s = l.s AND p.doc_id > l.doc_id),
steps AS (SELECT r, i, CASE WHEN i - lag(i) OVER w <= 50 THEN 0 ELSE 1 END AS opens FROM later WINDOW w AS (PARTITION BY r ORDER BY i)),
numbered AS (SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS k FROM steps),
runs AS (SELECT r, k, min(i) AS since, max(i) + 50 AS until FROM numbered GROUP BY r, k),
marks AS (
  SELECT r, since, until FROM runs
  UNION ALL SELECT r, n, n FROM size),
gaps AS (SELECT r, coalesce(lag(until) OVER w, 0) AS a, since AS b FROM marks WINDOW w AS (PARTITION BY r ORDER BY since, until)),
kept AS (SELECT g.r, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b) AS x FROM gaps g JOIN size s ON g.r = s.r GROUP BY g.r),
cut AS (SELECT r, sum(until - since)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM runs GROUP BY r)
SELECT s.doc_id, s.n AS n_bytes, coalesce(c.n_removed, 0) AS n_removed, coalesce(c.n_spans, 0) AS n_spans, sha256(unhex(k.x)) AS kept_sha256
FROM size s JOIN kept k ON s.r = k.r LEFT JOIN cut c ON s.r = c.r
"""


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against a list made by a rule from their own hosts.

    The tables hold neither fetch times nor lists. Page p counts as fetched p * 37 minutes
    (modulo 366 days) after 2024-01-01. Of the hosts whose md5 starts with 0-3 each is
    blocked on a day taken from its md5 and, if the next digit is even, allowed again 60
    days later; the site spam-farm.example.org is blocked from 2024-03-01, the section en
    of every host whose md5 starts with 4 from 2024-06-01, and example.net is allowed
    from the start.
    """
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetch_time", F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 2220, F.lit(31622400))))
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    h = hosts.select("host", F.md5(F.col("host").cast("binary")).alias("m"))
    day = F.conv(F.substring("m", 3, 2), 16, 10).cast("int")
    start = F.timestamp_seconds(F.lit(1704067200) + day * 86400)
    again = F.timestamp_seconds(F.lit(1704067200) + (day + 60) * 86400)
    block = h.where("substring(m, 1, 1) in ('0','1','2','3')")
    entries = (
        block.select(F.col("host").alias("pattern"), start.alias("listed_at"), F.lit("block").alias("action"))
        .unionByName(block.where("substring(m, 2, 1) in ('0','2','4','6','8','a','c','e')").select(F.col("host").alias("pattern"), again.alias("listed_at"), F.lit("allow").alias("action")))
        .unionByName(h.where("substring(m, 1, 1) = '4'").select(F.concat("host", F.lit("/en")).alias("pattern"), F.timestamp_seconds(F.lit(1717200000)).alias("listed_at"), F.lit("block").alias("action")))
        .unionByName(spark.sql("select 'spam-farm.example.org' as pattern, timestamp_seconds(1709251200) as listed_at, 'block' as action union all select 'example.net', timestamp_seconds(1704067200), 'allow'"))
    )
    out = url_filter.filter_captures(captures, entries)
    return out.withColumn("fetch_time", F.unix_seconds("fetch_time"))


OP2_SQL = r"""
WITH pages0 AS (
  SELECT page_id, url, 1704067200 + ((page_id * 2220) % 31622400 + 31622400) % 31622400 AS t,
    nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)', 1)), '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) AS seg
  FROM pages),
seen AS (SELECT page_id, url, t, host, seg, count(*) AS n_rows FROM pages0 GROUP BY ALL),
h AS (SELECT host, md5(host) AS m FROM (SELECT DISTINCT host FROM seen WHERE host IS NOT NULL)),
b AS (SELECT host, m, 1704067200 + ('0x' || substr(m, 3, 2))::BIGINT * 86400 AS since FROM h WHERE substr(m, 1, 1) IN ('0','1','2','3')),
entries AS (
  SELECT host AS pattern, since, 'block' AS action FROM b
  UNION ALL SELECT host, since + 60 * 86400, 'allow' FROM b WHERE substr(m, 2, 1) IN ('0','2','4','6','8','a','c','e')
  UNION ALL SELECT host || '/en', 1717200000, 'block' FROM h WHERE substr(m, 1, 1) = '4'
  UNION ALL SELECT 'spam-farm.example.org', 1709251200, 'block'
  UNION ALL SELECT 'example.net', 1704067200, 'allow'),
one AS (SELECT pattern, since, max(action) AS action FROM entries GROUP BY ALL),
spans AS (SELECT pattern, action, since, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until FROM one),
labels0 AS (SELECT *, string_split(host, '.') AS l FROM seen WHERE host IS NOT NULL),
keys AS (
  SELECT page_id, url, t, 0 AS pos, host || '/' || seg AS key FROM labels0 WHERE seg <> ''
  UNION ALL
  SELECT page_id, url, t, i, array_to_string(l[i:], '.') FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM labels0)),
hits AS (
  SELECT k.page_id, k.url, k.t, arg_min(s.pattern, k.pos) AS matched, arg_min(s.action, k.pos) AS action
  FROM keys k JOIN spans s ON k.key = s.pattern AND k.t >= s.since AND (s.until IS NULL OR k.t < s.until) GROUP BY ALL)
SELECT s.page_id, s.url, s.t AS fetch_time, s.n_rows, s.host, x.matched, x.action, coalesce(x.action, 'allow') <> 'block' AS kept
FROM seen s LEFT JOIN hits x ON s.page_id IS NOT DISTINCT FROM x.page_id AND s.url IS NOT DISTINCT FROM x.url AND s.t = x.t
"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed at source weights 1, 2, 3 in turn, none repeated more than 3 times."""
    return mixing.mix_sources(_read(spark, sf_dir, "documents"), (1, 2, 3), 3)


OP3_SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM base GROUP BY source),
lv AS (
  SELECT *, cap::DOUBLE / weight AS ratio,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0))::DOUBLE AS level
  FROM src WINDOW f AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tg AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * (SELECT arg_min(level, ratio) FROM lv WHERE ratio >= level)) AS target FROM lv),
plan AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS whole FROM tg),
ties AS (
  SELECT b.source, p.source_size, p.target, p.whole, floor(p.target - p.whole * p.source_size)::BIGINT AS rest, b.h, sum(b.size) AS words
  FROM base b JOIN plan p ON b.source IS NOT DISTINCT FROM p.source WHERE b.size > 0 GROUP BY ALL),
run AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM ties),
edge AS (
  SELECT source, min(h) AS edge_h, arg_min(2 * (rest - (upto - words)) >= words, h) AS take_edge FROM run WHERE upto > rest GROUP BY source)
SELECT b.doc_id, b.size, p.source_size, p.target,
  (b.size * (p.whole + CASE WHEN b.h < e.edge_h OR (b.h = e.edge_h AND e.take_edge) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM base b JOIN plan p ON b.source IS NOT DISTINCT FROM p.source LEFT JOIN edge e ON b.source IS NOT DISTINCT FROM e.source
"""


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all embeddings with equal labels at a cosine of 0.98 or more."""
    return embeddings.near_vectors(_read(spark, sf_dir, "embeddings"), 0.98)


#: Links are closed over whole components, so this is for tables whose groups are small.
OP4_SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS (
  SELECT r, label, e, sqrt(list_sum([x * x FOR x IN e])) AS size FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL
    AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
links AS (
  SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.label = b.label AND a.r <> b.r
  WHERE len(a.e) = len(b.e) AND list_sum([a.e[i] * b.e[i] FOR i IN range(1, len(a.e) + 1)]) >= 0.98 * a.size * b.size),
reach AS (
  SELECT r, r AS other FROM v
  UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.other = links.a),
least AS (SELECT reach.r, min(o.vec_id) AS component_id FROM reach JOIN v o ON reach.other = o.r GROUP BY reach.r),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, l.component_id, v.vec_id IS NOT DISTINCT FROM l.component_id AS kept
FROM v JOIN least l ON v.r = l.r LEFT JOIN counts c ON v.r = c.a
"""


def op5_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed id matrices of all documents, sequences of 2048 ids."""
    return packing.write_matrices(_read(spark, sf_dir, "documents"), tokens.default_path(), 2048)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by a factorisation machine learnt outside the held-out fold."""
    return quality.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), 0.7)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: sets of 4-word shingles, Jaccard similarity of 0.8 or more."""
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), width=4, percent=80)


#: Every pair that shares a shingle is counted and links are closed over whole components, so this is for small tables.
OP7_SQL = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
places AS (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0),
shingles AS (SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS s FROM places),
size AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r GROUP BY a.r, b.r),
links AS (
  SELECT s.a, s.b FROM shared s JOIN size x ON s.a = x.r JOIN size y ON s.b = y.r WHERE 100 * s.n >= 80 * (x.n + y.n - s.n)),
reach AS (
  SELECT r, r AS other FROM words
  UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.other = links.a),
least AS (SELECT reach.r, min(o.doc_id) AS component_id FROM reach JOIN words o ON reach.other = o.r GROUP BY reach.r)
SELECT w.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, l.component_id, w.doc_id IS NOT DISTINCT FROM l.component_id AS kept
FROM words w JOIN least l ON w.r = l.r LEFT JOIN size z ON w.r = z.r
"""


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 ids."""
    return packing.pack_documents(_read(spark, sf_dir, "documents"), tokens.default_path(), 1024)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical exact digests of all documents and of their edited texts."""
    return fingerprint.fingerprint_report(_read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by the string-kernel machine learnt outside the held-out fold."""
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), toxicity.THRESHOLD)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle manifest of all documents by language, and every row verified as it is or as tampered with."""
    docs = _read(spark, sf_dir, "documents")
    found = merkle.manifest(docs, *merkle.tampered(docs))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified", "place")


def _crc32(text: str) -> str:
    """The crc32 of a short ASCII string in SQL: a byte is xored in (values from 0), then eight shifts (-1)."""
    steps = f"flatten(list_transform(range(1, len({text}) + 1), lambda i: [ascii(substr({text}, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce({steps}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END, 4294967295::BIGINT), 4294967295)"


def _field_sql(c: str) -> str:
    return f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')"


OP11_SQL = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, lang, sha256({" || ".join(_field_sql(c) for c in merkle.FIELDS)}) AS leaf,
    sha256({" || ".join(_field_sql("n_chars::HUGEINT + CASE WHEN " + _crc32("doc_id::VARCHAR") + " % 7 = 0 THEN 1 ELSE 0 END" if c == "n_chars" else c) for c in merkle.FIELDS)}) AS shown
  FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM base),
nodes AS (
  SELECT lang, 0 AS level, place, n, leaf AS node FROM placed
  UNION ALL SELECT lang, level + 1, place // 2, (any_value(n) + 1) // 2, sha256(string_agg(node, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY lang, level, place // 2),
subroots AS MATERIALIZED (SELECT lang, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, place, n, node FROM subroots
  UNION ALL SELECT level + 1, place // 2, (any_value(n) + 1) // 2, sha256(string_agg(node, '' ORDER BY place)) FROM upper WHERE n > 1 GROUP BY level, place // 2),
rows AS (SELECT row_number() OVER () AS r, p.*, s.node AS subroot, s.place AS group_place, s.n AS groups FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang),
steps AS (
  SELECT r, a.level, CASE WHEN b.node IS NULL THEN '-' WHEN (a.place >> a.level) & 1 = 1 THEN 'L' || b.node ELSE 'R' || b.node END AS step
  FROM (SELECT *, unnest(range(0, ceil(log2(n))::INT)) AS level FROM rows) a LEFT JOIN nodes b ON a.lang IS NOT DISTINCT FROM b.lang AND a.level = b.level AND xor(a.place >> a.level, 1) = b.place
  UNION ALL
  SELECT r, 1000 + a.level, CASE WHEN b.node IS NULL THEN '-' WHEN (group_place >> a.level) & 1 = 1 THEN 'L' || b.node ELSE 'R' || b.node END
  FROM (SELECT *, unnest(range(0, ceil(log2(groups))::INT)) AS level FROM rows) a LEFT JOIN upper b ON a.level = b.level AND xor(a.group_place >> a.level, 1) = b.place),
paths AS (SELECT r, list(step ORDER BY level) AS path FROM steps GROUP BY r),
folded AS (
  SELECT w.*, coalesce(p.path, []) AS path, list_reduce(coalesce(p.path, []), lambda x, s: CASE substr(s, 1, 1) WHEN '-' THEN sha256(x) WHEN 'L' THEN sha256(substr(s, 2) || x) ELSE sha256(x || substr(s, 2)) END, shown) AS folded_root
  FROM rows w LEFT JOIN paths p USING (r))
SELECT doc_id, leaf, subroot, (SELECT node FROM upper WHERE n = 1) AS root, sha256(array_to_string([substr(s, 2) FOR s IN path], '')) AS proof_sha256, folded_root,
  folded_root = (SELECT node FROM upper WHERE n = 1) AS verified, place
FROM folded
"""


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: counts of the named kinds, a digest of their spans, and all spans with the random strings."""
    found = secret_scan.scan(_read(spark, sf_dir, "documents"))

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = F.filter("spans", lambda x: x["kind"] != "random")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), of("random").alias("n_random"),
    )


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under two public tokenizers: minimal groups, links and the counts of linked pairs."""
    found = alignment.align(_read(spark, sf_dir, "documents"), *alignment.default_paths(), with_groups=False)
    return found.drop("groups")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_url_filters": op2_url_filters,
    "op3_mixing": op3_mixing,
    "op4_embeddings": op4_embeddings,
    "op5_token_matrices": op5_token_matrices,
    "op6_quality": op6_quality,
    "op7_minhash": op7_minhash,
    "op8_packing": op8_packing,
    "op9_fingerprints": op9_fingerprints,
    "op10_toxicity": op10_toxicity,
    "op11_merkle": op11_merkle,
    "op12_secrets": op12_secrets,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {"op1_suffix_dedup": OP1_SQL, "op2_url_filters": OP2_SQL, "op3_mixing": OP3_SQL, "op4_embeddings": OP4_SQL, "op7_minhash": OP7_SQL, "op11_merkle": OP11_SQL}
