"""Integrity: duplicates, digests, parity of id sets, coverage, row contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources import tables


def duplicate_groups(rows: DataFrame, key: Column, id_col: str = "doc_id") -> DataFrame:
    """Groups of rows with an equal key: digest, n, first_id, last_id. Ids are summed up, not gathered."""
    g = rows.select(T.sha256(key).alias("digest"), F.col(id_col).alias("i")).groupBy("digest")
    return g.agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first_id"), F.max("i").alias("last_id")).where("n > 1")


def duplicate_members(rows: DataFrame, key: Column, id_col: str = "doc_id") -> DataFrame:
    """The rows of groups with an equal key: digest, id. The groups are found by counts; a member is a row, so no group is gathered."""
    each = rows.select(T.sha256(key).alias("digest"), F.col(id_col))
    many = each.groupBy(F.col("digest").alias("d")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d")
    return each.join(many, F.col("digest") == F.col("d"), "left_semi")


def body_only(text: Column) -> Column:
    """A Markdown text without its title and source lines."""
    kept = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~(x.startswith("# ") | x.startswith("Source: ")))
    return F.trim(F.array_join(kept, "\n"))


def parity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids on one side only, with the side that has them."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))


def set_digest(rows: DataFrame, by: str, item: Column) -> DataFrame:
    """A digest of each group's items that does not depend on their order, without gathering them.

    It is of the number of items and of four sums of 60-bit words of their sha256: equal
    multisets agree, and unequal ones agree by chance with a probability of about 2 ** -240.
    Whoever can choose items can also make sums meet; against that ``ordered_digest`` holds.
    """
    h = T.sha256(item)
    words = [F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)").alias(f"w{k}") for k in range(4)]
    g = rows.select(F.col(by), *words).groupBy(by)
    n = F.count(F.lit(1))
    return g.agg(n.alias("n"), T.sha256(F.concat_ws(":", n.cast("string"), *(F.sum(f"w{k}").cast("string") for k in range(4)))).alias("digest"))


def ordered_digest(rows: DataFrame, by: str, line: Column, part: Column) -> DataFrame:
    """A digest of each group's sorted lines: sha256 over the sorted lines of each part, then over the parts' digests in order.

    A tree of two levels, as one sha256 over all lines would need them in one task; parts
    (a whole number per line) bound what is gathered.
    """
    parts = rows.select(F.col(by), part.alias("part"), line.alias("line")).groupBy(by, "part")
    parts = parts.agg(F.count(F.lit(1)).alias("n"), T.sha256(F.array_join(F.sort_array(F.collect_list("line")), "\n")).alias("h"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), "\n")
    return parts.groupBy(by).agg(F.sum("n").alias("n"), T.sha256(whole).alias("digest"))


def gate(pins: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Pinned digests (key, digest) against those of now, as one row: pinned, changed, lost, added and the changed keys."""
    a, b = pins.select(F.col(key).alias("k"), F.col("digest").alias("pin")), now.select(F.col(key).alias("l"), F.col("digest").alias("found"))
    j = a.join(b, F.col("k").eqNullSafe(F.col("l")), "full_outer")
    changed = F.col("pin").isNotNull() & F.col("found").isNotNull() & (F.col("pin") != F.col("found"))
    return j.agg(
        F.count("pin").alias("pinned"), F.count_if(changed).alias("changed"), F.count_if(F.col("found").isNull()).alias("lost"), F.count_if(F.col("pin").isNull()).alias("added"),
        F.array_join(F.sort_array(F.collect_list(F.when(changed, F.coalesce(F.col("k").cast("string"), F.lit("null"))))), ",").alias("changed_ids"),
    )


FAN = 4  # bits of a place that a level of a digest tree takes


def digest_tree(rows: DataFrame, width: int = 1024) -> DataFrame:
    """level, node, n, digest of rows (key long, digest): leaves are ranges of ``width`` keys, a node is of 2 ** FAN nodes below; the top is one node for keys of one sign.

    A leaf's digest is of its rows' keys and digests in order; rows that repeat a key count each.
    """
    line = F.format_string("%d:%s", "key", "digest")
    level = rows.select(F.floor(F.col("key") / width).alias("node"), line.alias("line")).groupBy("node").agg(F.count(F.lit(1)).alias("n"), T.sha256(F.array_join(F.sort_array(F.collect_list("line")), "\n")).alias("digest"))
    tree, depth = tables.written(level, "leaves"), 0
    out = tree.select(F.lit(0).alias("level"), "node", "n", "digest")
    while tree.count() > 2:  # at most 16 levels
        depth += 1
        below = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "digest"))), lambda x: F.format_string("%d:%s", x["node"], x["digest"])), "\n")
        tree = tables.written(tree.groupBy(F.shiftright("node", FAN).alias("up")).agg(F.sum("n").alias("n"), T.sha256(below).alias("digest")).withColumnRenamed("up", "node"), "level")
        out = out.unionByName(tree.select(F.lit(depth).alias("level"), "node", "n", "digest"))
    return out


def differing_leaves(a: DataFrame, b: DataFrame) -> DataFrame:
    """Leaves (node) that differ between two digest trees, found from the top down: only children of nodes that differ are looked at."""
    depth = a.agg(F.max("level")).unionByName(b.agg(F.max("level"))).agg(F.max("max(level)")).first()[0] or 0
    wrong = None
    for level in range(depth, -1, -1):
        x, y = (t.where(F.col("level") == level).select(F.col("node").alias(n), F.col("digest").alias(d)) for t, n, d in ((a, "x", "dx"), (b, "y", "dy")))
        if wrong is not None:
            x, y = (t.join(wrong.withColumnRenamed("node", "up"), F.shiftright(n, FAN) == F.col("up"), "left_semi") for t, n in ((x, "x"), (y, "y")))
        j = x.join(y, F.col("x") == F.col("y"), "full_outer").where(~F.col("dx").eqNullSafe(F.col("dy")))
        found = j.select(F.coalesce("x", "y").alias("node"))
        # where one tree is not as high as the other, all of its nodes are looked at
        low = level > min(t.agg(F.max("level")).first()[0] or 0 for t in (a, b))
        wrong = None if low else tables.written(found, "differing")
    return wrong


def changed_rows(pinned: DataFrame, now: DataFrame, trees: tuple[DataFrame, DataFrame] | None = None, width: int = 1024) -> DataFrame:
    """key, status (changed, lost, added) of rows (key, digest) of two versions; only the key ranges that differ are compared. Null keys are in neither."""
    pinned, now = pinned.where("key is not null"), now.where("key is not null")
    a, b = trees or (digest_tree(pinned, width), digest_tree(now, width))
    leaves = differing_leaves(a, b)
    x, y = (r.join(leaves, F.floor(F.col("key") / width) == F.col("node"), "left_semi").groupBy("key").agg(F.sort_array(F.collect_list("digest")).alias("d")) for r in (pinned, now))
    x, y = x.select(F.col("key").alias("k"), F.col("d").alias("before")), y.select("key", F.col("d").alias("after"))
    j = x.join(y, F.col("k") == F.col("key"), "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "lost").otherwise("changed")
    return j.select(F.coalesce("k", "key").alias("key"), status.alias("status"))


def coverage(required: DataFrame, available: DataFrame, group: str, item: str) -> DataFrame:
    """Per group the number of required items and those present and missing."""
    have = available.select(group, item).distinct().withColumn("_have", F.lit(True))
    j = required.join(have, [group, item], "left")
    return j.groupBy(group).agg(F.count(F.lit(1)).alias("required"), F.count("_have").alias("present"), F.count_if(F.col("_have").isNull()).alias("missing"), F.sort_array(F.collect_set(F.when(F.col("_have").isNull(), F.col(item)))).alias("missing_items"))


def multiset_coverage(raw: DataFrame, captured: DataFrame, key: str, token: str) -> DataFrame:
    """Share of each document's raw tokens that the captured text has, counted as multisets."""
    a = raw.groupBy(key, token).agg(F.count(F.lit(1)).alias("n"))
    b = captured.groupBy(key, token).agg(F.count(F.lit(1)).alias("m"))
    j = a.join(b, [key, token], "left")
    return j.groupBy(key).agg(F.sum("n").alias("raw_tokens"), F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("shared")).withColumn("share", F.round(F.col("shared") / F.col("raw_tokens"), 6))


def kept_coverage(rows: DataFrame, key: str, raw: Column, kept: Column) -> DataFrame:
    """``multiset_coverage`` where what is kept (an array of tokens) is a part of the raw ones, as multisets: then all of it is shared, so sizes say it and no token is shuffled. Of a null key nothing is shared."""
    shared = F.when(F.col(key).isNotNull(), F.size(kept)).otherwise(0)
    each = rows.select(key, F.size(raw).alias("n"), shared.alias("m")).where("n > 0")
    g = each.groupBy(key).agg(F.sum("n").alias("raw_tokens"), F.sum("m").alias("shared"))
    return g.withColumn("share", F.round(F.col("shared") / F.col("raw_tokens"), 6))
