"""A Merkle manifest of a dataset: a root, and for each row the siblings that lead its leaf to that root.

Rows of one group form a tree, in the order of their ids; the roots of the groups, in the
order of the groups, form the tree above. Trees are cut into aligned blocks of 2 ** HEIGHT
leaves. A pass over a tree's blocks gives their roots, which are the leaves of a tree that
is as many times smaller, and so on until one node is left. Then paths come down again: a
block takes the path of its own root from above, and its leaves' paths are made leaf by
leaf by a traversal schedule: for each height a treehash stack makes, in at most two steps
a leaf, the node that the path will need next at that height, so a task holds one block's
leaves, a path, and HEIGHT stacks of at most HEIGHT nodes.

No group, however large, is in one task: positions come from a range partitioning (rows
with equal ids and equal leaves are dealt apart by a random number, as their order does not
matter) and counts by group and partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import arrow_schema, concat, materialize, release, small_batches, to_batch

HEIGHT = 9  # levels of a block
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def row_leaf(fields: list[Column]) -> Column:
    """sha256 of fields, each as its UTF-8 byte count, a colon and its value as text, or ``-`` if null."""
    def one(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*map(one, fields)), 256)


# --- one block ----------------------------------------------------------------------------


class Treehash:
    """Makes node ``j`` of height ``h`` over the leaves there are, one leaf or one hash a step. A node without a right sibling goes up alone."""

    __slots__ = ("at", "end", "h", "stack")

    def __init__(self, j: int, h: int, n: int) -> None:
        self.at, self.end, self.h, self.stack = j << h, min((j + 1) << h, n), h, []

    def step(self, leaves: list[str]) -> bool:
        """False if there was nothing left to do."""
        s = self.stack
        if len(s) > 1 and s[-1][0] == s[-2][0]:
            h, right = s.pop()
            s[-1] = (h + 1, digest(s[-1][1], right))
        elif self.at < self.end:
            s.append((0, leaves[self.at]))
            self.at += 1
        elif s and s[0][0] < self.h:
            h, alone = s[-1]
            s[-1] = (h + 1, digest(alone))
        else:
            return False
        return True

    @property
    def node(self) -> str | None:
        """The node; None if it has no leaves."""
        return self.stack[0][1] if self.stack else None


def levels(n_leaves: int) -> int:
    """Levels above n leaves until one node remains."""
    return max(n_leaves - 1, 0).bit_length()


def block_root(leaves: list[str], height: int) -> str:
    tree = Treehash(0, height, len(leaves))
    while tree.step(leaves):
        pass
    return tree.node


def traverse(leaves: list[str], height: int) -> Iterator[list[str | None]]:
    """Of each leaf in turn its siblings by level, None where it goes up alone."""
    n = len(leaves)
    path: list[str | None] = [None] * height
    stacks = [Treehash(0, h, n) for h in range(height)]
    for h, first in enumerate(stacks):
        right = Treehash(1, h, n)
        while first.step(leaves) or right.step(leaves):
            pass
        path[h] = right.node
    for leaf in range(n):
        if leaf:
            for h in range(height):
                if leaf & ((1 << h) - 1):
                    break
                path[h] = stacks[h].node
                stacks[h] = Treehash(((leaf >> h) + 1) ^ 1, h, n)
        yield path
        for s in stacks:
            if s.step(leaves):
                s.step(leaves)


def climb(node: str, path: list[str | None], place: int) -> str:
    """The node at the end of a path of siblings."""
    for h, sibling in enumerate(path):
        node = digest(node) if sibling is None else digest(sibling, node) if place >> h & 1 else digest(node, sibling)
    return node


# --- positions ------------------------------------------------------------------------------


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0, in the order of ``order`` within a tree, null first) and ``n`` (rows of the tree)."""
    dealt = rows.withColumn("_salt", F.rand(11))
    dealt = dealt.repartitionByRange(tree, *order, "_salt").sortWithinPartitions(tree, *order).drop("_salt")
    numbered = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = numbered.groupBy(F.col(tree).alias("_tree"), part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    of_tree = W.partitionBy("_tree")  # as many rows as partitions
    before = F.coalesce(F.sum("_n").over(of_tree.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = materialize(counts.select("_tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(of_tree).alias("n")), "offsets")
    j = numbered.join(counts, F.col(tree).eqNullSafe(F.col("_tree")) & (part == F.col("_part")))
    placed = materialize(j.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("place"), "n"), "placed")
    release(numbered, counts)
    return placed


def block_roots(rows: DataFrame, height: int) -> DataFrame:
    """Of rows (tree, place, n, node) the roots of their blocks of 2 ** height, as rows of the same columns."""
    block = F.shiftright("place", height)
    keyed = rows.select("tree", block.alias("block"), "place", "n", "node").repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
    schema = StructType([rows.schema["tree"], *StructType.fromDDL("place long, n long, node string").fields])
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves: list[str] = []
        for batch in batches:
            place, n, node = (batch.column(c).to_pylist() for c in ("place", "n", "node"))
            roots: list[str] = []
            last: list[int] = []
            for i, x in enumerate(node):
                leaves.append(x)
                if place[i] + 1 == n[i] or (place[i] + 1) & ((1 << height) - 1) == 0:
                    roots.append(block_root(leaves, height if n[i] > 1 << height else levels(n[i])))
                    last.append(i)
                    leaves = []
            tree = batch.column("tree").take(pa.array(last, pa.int64()))
            yield to_batch({"tree": tree, "place": [place[i] >> height for i in last], "n": [-(-n[i] >> height) for i in last], "node": roots}, kinds)

    return keyed.mapInArrow(run, schema)


# --- paths ------------------------------------------------------------------------------------


def write_path(path: list[str | None], place: int) -> str:
    """A path as text: per level ``L`` or ``R`` and the sibling there, or ``-``."""
    return "".join("-" if x is None else ("L" if place >> h & 1 else "R") + x for h, x in enumerate(path))


def read_path(text: str) -> tuple[list[str | None], int]:
    """The siblings of a written path, and the bits of its place."""
    path, place, i = [], 0, 0
    while i < len(text):
        if text[i] == "-":
            path.append(None)
        else:
            place |= (text[i] == "L") << len(path)
            path.append(text[i + 1 : i + 65])
        i += 1 if text[i] == "-" else 65
    return path, place


def _led(rows: DataFrame, above: DataFrame, payload: list[str], height: int) -> DataFrame:
    """Rows of each block behind the row of ``above`` (tree, place of the block, path, subroot, root) that is theirs."""
    kinds = {f.name: f.dataType for f in rows.schema}
    null = lambda c: F.lit(None).cast(kinds[c])
    a = above.select("tree", F.col("place").alias("block"), F.lit(-1).cast("long").alias("place"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("node"), *(null(c).alias(c) for c in payload), "path", "subroot", "root")
    none = F.lit(None).cast("string")
    b = rows.select("tree", F.shiftright("place", height).alias("block"), "place", "n", "node", *payload, none.alias("path"), none.alias("subroot"), none.alias("root"))
    return a.union(b).repartition("tree", "block").sortWithinPartitions("tree", "block", "place")


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Batches cut where a block begins, and those places."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        starts = [i for i, p in enumerate(batch.column("place").to_pylist()) if p == -1]
        if not starts:
            rest.append(batch)
            continue
        whole = concat([*rest, batch.slice(0, starts[-1])])
        if whole.num_rows:
            held = sum(b.num_rows for b in rest)
            yield whole, ([0] if held else []) + [s + held for s in starts[:-1]]
        rest = [batch.slice(starts[-1])]
    if rest:
        yield concat(rest), [0]


def _paths(rows: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """tree, place, path, subroot, root of the nodes of a level, from those of the level above."""
    led = _led(rows, above, [], height)
    schema = StructType([rows.schema["tree"], *StructType.fromDDL("place long, path string, subroot string, root string").fields])
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _whole_blocks(batches):
            c = {k: batch.column(k).to_pylist() for k in ("place", "n", "node", "path", "subroot", "root")}
            out: dict[str, list] = {"place": [], "path": [], "subroot": [], "root": []}
            keep: list[int] = []
            for lo, hi in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                leaves = c["node"][lo + 1 : hi]
                for i, path in enumerate(traverse(leaves, height if c["n"][lo + 1] > 1 << height else levels(len(leaves))), lo + 1):
                    keep.append(i)
                    out["place"].append(c["place"][i])
                    out["path"].append(write_path(path, i - lo - 1) + c["path"][lo])
                    out["subroot"].append(c["subroot"][lo])
                    out["root"].append(c["root"][lo])
            yield to_batch(out | {"tree": batch.column("tree").take(pa.array(keep, pa.int64()))}, kinds)

    return led.mapInArrow(run, schema)


def _proofs(rows: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """The rows of ``manifest`` from leaves and the paths of their blocks."""
    led = _led(rows, above, ["id", "shown"], height)
    schema = StructType([rows.schema["id"], rows.schema["tree"], *StructType.fromDDL("place long, leaf string, proof string, subroot string, root string, folded_root string").fields])
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _whole_blocks(batches):
            c = {k: batch.column(k).to_pylist() for k in ("place", "n", "node", "shown", "path", "subroot", "root")}
            out: dict[str, list] = {k: [] for k in ("place", "leaf", "proof", "subroot", "root", "folded_root")}
            keep: list[int] = []
            for lo, hi in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                leaves = c["node"][lo + 1 : hi]
                upper, bits = read_path(c["path"][lo])
                tail = "".join(x for x in upper if x)
                folded: dict[str, str] = {}  # of a node at the block's height: what it comes to at the root
                for i, path in enumerate(traverse(leaves, height if c["n"][lo + 1] > 1 << height else levels(len(leaves))), lo + 1):
                    at = climb(c["shown"][i] or c["node"][i], path, i - lo - 1)
                    if at not in folded:
                        folded[at] = climb(at, upper, bits)
                    keep.append(i)
                    out["place"].append(c["place"][i])
                    out["leaf"].append(c["node"][i])
                    out["proof"].append("".join(x for x in path if x) + tail)
                    out["subroot"].append(c["subroot"][lo])
                    out["root"].append(c["root"][lo])
                    out["folded_root"].append(folded[at])
            took = pa.array(keep, pa.int64())
            yield to_batch(out | {"id": batch.column("id").take(took), "tree": batch.column("tree").take(took)}, kinds)

    return led.mapInArrow(run, schema)


def _up(rows: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all trees, rows (tree, place, n, node), from the leaves' blocks up; and (tree, node) of their roots."""
    found, roots = [rows], None
    while True:
        blocks = materialize(block_roots(found[-1], height), "blocks")
        done = blocks.where("n = 1").select("tree", "node")
        roots = done if roots is None else roots.unionByName(done)
        blocks = blocks.where("n > 1")
        if blocks.isEmpty():
            return found, roots
        found.append(blocks)


def _down(found: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """Paths of the blocks of the lowest level; tops: tree, place (0), path, subroot, root of all trees' roots.

    A tree's topmost block takes its path from ``tops``, all others from the level above.
    """
    above = tops
    for rows in reversed(found[1:]):
        here = rows.select(F.col("tree").alias("_tree")).distinct()
        same = F.col("tree").eqNullSafe(F.col("_tree"))
        made = _paths(rows, above.join(here, same, "left_semi"), height)
        above = materialize(made.unionByName(tops.join(here, same, "left_anti")), "paths")
    return above


def manifest(docs: DataFrame, leaf: Column, shown: Column, group: str = "lang", order: str = "doc_id", height: int = HEIGHT) -> DataFrame:
    """One row per row of ``docs``: its id (named as ``order``), ``group``, leaf, subroot (root of its group's tree), root,
    proof (siblings from the leaf to the root, 64 hex digits each), place, folded_root (what the row as ``shown`` comes to
    with that proof) and verified (whether that is the root).

    leaf: a digest (lowercase hex) of the row; shown: that of the row as it is presented for
    verification. Null groups are one group, the first. Null ids come first in their
    group; rows with equal ids go by their leaves, and repeated rows get proofs of their
    own. A lone leaf is its group's root; its proof within the group is empty. No rows
    give no rows. Other columns of ``docs`` are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(order).alias("id"), F.col(group).alias("tree"), leaf.alias("node"), shown.alias("shown"))
    rows = rows.withColumn("shown", F.when(F.col("shown") != F.col("node"), F.col("shown")))
    leaves = materialize(rows, "leaves")
    placed = ranked(leaves, "tree", ["id", "node"])
    release(leaves)
    found, roots = _up(placed, height)
    groups = ranked(roots.select(F.lit(0).alias("tree"), F.col("tree").alias("of"), "node"), "tree", ["of"])
    over, whole = _up(groups.select("tree", "place", "n", "node"), height)
    none = F.lit(None).cast("string")
    top = whole.select("tree", F.lit(0).cast("long").alias("place"), F.lit("").alias("path"), none.alias("subroot"), F.col("node").alias("root"))
    up = _paths(over[0], _down(over, top, height), height).select(F.col("place").alias("p"), "path", "root")
    of_group = groups.join(up, F.col("place") == F.col("p")).select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("place"), "path", F.col("node").alias("subroot"), "root")
    out = _proofs(placed, _down(found, materialize(of_group, "paths"), height), height)
    return out.select(F.col("id").alias(order), F.col("tree").alias(group), "leaf", "subroot", "root", "proof", "place", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def tampered(docs: DataFrame) -> tuple[Column, Column]:
    """Leaves of ``documents`` rows, and of the rows as presented: where 7 divides the crc32 of the id, n_chars is one more."""
    claimed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars").cast("decimal(38,0)") + 1).otherwise(F.col("n_chars").cast("decimal(38,0)"))
    return row_leaf([F.col(c) for c in FIELDS]), row_leaf([claimed if c == "n_chars" else F.col(c) for c in FIELDS])
