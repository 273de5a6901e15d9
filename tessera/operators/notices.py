"""Identification of notices and selection of their context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import notice as N
from tessera.functions import text as T

MAX_LINES, NEAR_HEADER, WINDOW = 80, 40, 4
# Fixed values. What may stand before a code, alone above it, and between two codes.
LABEL = r"(?i)(?:IRS\s+)?(?:notice|letter)(?:\s+(?:number|type))?\s*[:#-]?\s*"
LABEL_ABOVE = r"(?i)(?:notice|letter)"
CONNECTOR = r"(?i)\s*(?:/|,|and|&)\s*"


def identify(rows: DataFrame, available: list[str]) -> DataFrame:
    """notice_id, status, notice_code, route, confidence of texts (notice_id, text).

    The first 80 nonempty lines are read. A code counts with 0.99 if a label stands before
    it in the line or alone in the line above, or if connectors join it to such a code, with
    0.96 if it is all of its line. Codes within four lines of the first decide; LT11 and
    Letter 1058 are one notice.
    """
    lines = rows.select("notice_id", F.filter(F.transform(T.lines(F.col("text")), T.squeeze_all), lambda x: x != "").alias("ls"))
    each = lines.select("notice_id", F.posexplode(F.slice("ls", 1, MAX_LINES)).alias("pos", "line"))
    each = each.withColumn("above", F.lag("line").over(W.partitionBy("notice_id").orderBy("pos")))
    # the line with its codes marked, so that labels and connectors are seen around them
    marked = F.regexp_replace("line", N.java(N.CODE), "\u0001$1\u0001")
    parts = each.select("notice_id", "pos", "line", "above", F.split(marked, "\u0001").alias("p"))
    head = F.trim(F.col("p")[0])
    labelled = head.rlike(N.whole(LABEL)) | F.coalesce(F.col("above").rlike(N.whole(LABEL_ABOVE)), F.lit(False))
    n_codes = F.floor((F.size("p") - 1) / 2).cast("int")
    codes = parts.where(F.size("p") > 1).select("notice_id", "pos", "line", "p", labelled.alias("labelled"), F.explode(F.sequence(F.lit(1), n_codes)).alias("k"))
    raw = F.element_at("p", F.col("k") * 2)
    gaps = F.transform(F.sequence(F.lit(1), F.col("k")), lambda i: F.when(i == 1, True).otherwise(F.element_at("p", i * 2 - 1).rlike(N.whole(CONNECTOR))))
    code = N.normalize_code(raw)
    by_label = F.col("labelled") & F.forall(gaps, lambda x: x)
    alone = F.coalesce(N.normalize_code(F.col("line")) == code, F.lit(False))
    near = F.col("pos") < NEAR_HEADER
    confidence = F.when(by_label & near, 0.99).when(alone & near, 0.96).otherwise(0.55)
    found = codes.select("notice_id", "pos", code.alias("code"), confidence.alias("confidence")).where("code is not null and confidence >= 0.9")
    first = F.min("pos").over(W.partitionBy("notice_id"))
    close = found.withColumn("first", first).where(F.col("pos") <= F.col("first") + WINDOW)
    same = F.when(F.col("code") == "LETTER1058", "LT11").otherwise(F.col("code"))
    g = close.groupBy("notice_id").agg(F.count_distinct(same).alias("n"), F.max_by("code", F.struct("confidence", F.col("code") != "LETTER1058")).alias("code"), F.max("confidence").alias("confidence"))
    j = rows.select("notice_id").join(g.withColumnRenamed("notice_id", "g_id"), F.col("notice_id") == F.col("g_id"), "left")
    status = F.when(F.col("n").isNull(), "unidentified").when(F.col("n") > 1, "ambiguous").otherwise("identified")
    known = F.when(F.col("n") == 1, F.col("code"))
    return j.select("notice_id", status.alias("status"), known.alias("notice_code"), N.route(known, F.array(*map(F.lit, available))).alias("route"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def select_context(rows: DataFrame, notice: Column, question: Column, most: int = 30, chars: int = 4000) -> Column:
    """Lines of a redacted notice that share two or more terms with a question, best first for the cut, in order for the text."""
    word = r"[A-Za-z0-9$]+"
    terms = F.filter(F.array_distinct(F.regexp_extract_all(F.lower(question), F.lit(word), F.lit(0))), lambda t: (F.length(t) >= 4) & ~t.isin(N.STOPWORDS))
    lines = F.split(N.redact(notice), "\n")
    scored = F.transform(lines, lambda line, i: F.struct((-F.size(F.array_intersect(terms, F.regexp_extract_all(F.lower(line), F.lit(word), F.lit(0))))).alias("s"), i.alias("i"), line.alias("line")))
    good = F.filter(scored, lambda x: (x["s"] <= -2) & (x["i"] >= 20))
    best = F.slice(F.sort_array(good), 1, most)
    ordered = F.sort_array(F.transform(best, lambda x: F.struct(x["i"].alias("i"), x["line"].alias("line"))))
    return F.substring(F.array_join(F.array_distinct(F.transform(ordered, lambda x: x["line"])), "\n"), 1, chars)
