"""Packing of tokenised documents into sequences of bounded length.

How pieces fit together depends on their lengths alone, and those are at most
``capacity`` different whole numbers. So the cluster counts pieces by length, the driver
packs this histogram (at most ``capacity`` numbers, whatever the corpus), and the plan
comes back as runs: ranks lo..hi of a length go to sequences from seq0 on, ``each`` to a
sequence, from ``offset`` on. Pieces get their ranks by length in parallel: counts by
length and hash bucket are summed up, and a bucket numbers its own.

Two planners:

- ``best_fit_decreasing``: sizes in decreasing order, each into the fullest open
  sequence that takes it; open sequences are kept by free capacity and found with a
  segment tree.
- ``dominance_then_best_fit``: the reduction of Martello and Toth first fixes sequences
  that some best packing must contain, then best fit decreasing packs what remains.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import arrow_schema, map_arrow, materialize, partitions, to_batch
from .tokens import cuts, encoder

EOD = 2
IDS_AT_ONCE = 1 << 20


class CapacityTree:
    """Counts of open sequences by free capacity; finds the least free capacity that is enough."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)

    def add(self, free: int, n: int) -> None:
        at = self.leaves + free
        while at:
            self.count[at] += n
            at //= 2

    def at_least(self, size: int) -> int | None:
        """The least free capacity >= size of an open sequence."""
        at = self.leaves + size
        if self.count[at]:
            return size
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


@dataclass
class Plan:
    """Runs (length, lo, hi, seq0, each, offset) and the number of sequences."""

    capacity: int
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    placed: dict[int, int] = field(default_factory=dict)

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def place(self, length: int, n: int, seq0: int, each: int, offset: int) -> None:
        """n pieces into sequences from seq0 on, ``each`` to a sequence."""
        lo = self.placed.get(length, 0)
        self.runs.append((length, lo, lo + n, seq0, each, offset))
        self.placed[length] = lo + n

    def whole(self, pattern: list[tuple[int, int]], n: int) -> None:
        """n new sequences that all hold ``pattern``: (length, times)."""
        seq0, offset = self.open(n), 0
        for length, times in pattern:
            self.place(length, n * times, seq0, times, offset)
            offset += length * times


def best_fit_decreasing(histogram: dict[int, int], capacity: int, plan: Plan | None = None) -> Plan:
    """Pack pieces, the longest first, each where the least room is left.

    Sequences of equal content are one group (seq0, number, free). The copies of a size
    that go to a group fill its sequences one after the other, as best fit does.
    """
    plan = plan or Plan(capacity)
    tree, groups = CapacityTree(capacity), {}

    def keep(free: int, seq0: int, n: int) -> None:
        if n and free:
            groups.setdefault(free, []).append((seq0, n))
            tree.add(free, n)

    for size in sorted((s for s, n in histogram.items() if n), reverse=True):
        left = histogram[size]
        later = []  # groups that this size has filled, open again for the next size
        while left:
            free = tree.at_least(size)
            if free is None:
                each = capacity // size
                full, rest = divmod(left, each)
                if full:
                    seq0 = plan.open(full)
                    plan.place(size, full * each, seq0, each, 0)
                    later.append((capacity - each * size, seq0, full))
                if rest:
                    seq0 = plan.open(1)
                    plan.place(size, rest, seq0, rest, 0)
                    later.append((capacity - rest * size, seq0, 1))
                break
            seq0, n = groups[free].pop()
            tree.add(free, -n)
            each = free // size
            full = min(n, left // each)
            if full:
                plan.place(size, full * each, seq0, each, capacity - free)
                later.append((free - full // full * each * size, seq0, full))
                left -= full * each
            if full < n and left and left < each:
                plan.place(size, left, seq0 + full, left, capacity - free)
                later.append((free - left * size, seq0 + full, 1))
                full, left = full + 1, 0
            keep(free, seq0 + full, n - full)
        for free, seq0, n in later:
            keep(free, seq0, n)
    return plan


def dominance_then_best_fit(histogram: dict[int, int], capacity: int) -> Plan:
    """Fix sequences by Martello and Toth's dominance, then pack the rest by best fit decreasing.

    A feasible set {i} + F dominates if every other feasible set with i can be split into
    parts that fit the members of F one to one; then some best packing contains {i} + F
    and it is fixed for good. Tried for each size i, the longest first, until none is left:

    - nothing fits beside i: {i};
    - a piece fills i up exactly, or at most one piece fits beside i: i with the longest that fits;
    - at most two fit: i with the longest that fits if no pair is longer; else i with the
      longest pair, if it holds the longest single fit and its smaller member is no
      smaller than that of any other pair that fits.
    """
    plan, have = Plan(capacity), {s: n for s, n in histogram.items() if n}
    changed = True
    while changed and have:
        changed = False
        for size in sorted(have, reverse=True):
            while have.get(size):
                found = _dominating(have, size, capacity)
                if found is None:
                    break
                times = {s: found.count(s) for s in found}
                n = min(have[s] // t for s, t in times.items())
                plan.whole(sorted(times.items(), reverse=True), n)
                for s, t in times.items():
                    have[s] -= n * t
                    if not have[s]:
                        del have[s]
                changed = True
    return best_fit_decreasing(have, capacity, plan)


def _dominating(have: dict[int, int], size: int, capacity: int) -> list[int] | None:
    """The sizes of a dominating set with ``size``, or None. All of its copies stay available for the tests."""
    room = capacity - size
    rest = have | {size: have[size] - 1}
    order = sorted(s for s, n in rest.items() if n)
    smallest = [s for s in order[:3] for _ in range(min(3, rest[s]))][:3]
    if not smallest or smallest[0] > room:
        return [size]
    if rest.get(room):
        return [size, room]
    fits = [s for s in order if s <= room]
    longest = fits[-1]
    if len(smallest) < 2 or sum(smallest[:2]) > room:
        return [size, longest]
    if len(smallest) < 3 or sum(smallest[:3]) > room:
        best, least = (0, 0, 0), 0
        j = 0
        for a in reversed(fits):  # the larger member; the smaller one grows as it falls
            while j + 1 < len(fits) and fits[j + 1] + a <= room:
                j += 1
            b = min(fits[j], a)
            while b + a > room or (b == a and rest[a] < 2):
                lower = [s for s in fits if s < b]
                if not lower:
                    break
                b = lower[-1]
            else:
                best, least = max(best, (a + b, a, b)), max(least, b)
        if longest >= best[0]:
            return [size, longest]
        if best[1] == longest and best[2] >= least:
            return [size, best[1], best[2]]
    return None


def pieces_of(docs: DataFrame, path: str, capacity: int, end: int = EOD) -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length and ids_crc32 (of the ids as little-endian 32-bit words)."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        encode = encoder(path)
        out = {k: [] for k in ("row", "piece", "start", "length", "ids_crc32")}
        for r, text in enumerate(batch.column(1)):
            ids = np.append(encode(text.as_py() or ""), np.uint32(end)).astype("<u4")
            for p, (start, length) in enumerate(cuts(len(ids), capacity)):
                part = ids[start : start + length]
                for k, v in (("row", r), ("piece", p), ("start", start), ("length", length), ("ids_crc32", zlib.crc32(part.tobytes()))):
                    out[k].append(v)
        yield {"doc_id": batch.column(0).take(pa.array(out.pop("row"))), **out}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def histogram_of(pieces: DataFrame) -> dict[int, int]:
    """Pieces by length: at most ``capacity`` rows."""
    return {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}


BUCKET_ROWS = 1 << 16


def place(pieces: DataFrame, plan: Plan, histogram: dict[int, int]) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    Ranks of a length are dealt to buckets of about BUCKET_ROWS pieces, by a hash of the
    piece; the counts of all buckets, summed up, say where each begins. Counts and pieces
    are joined by sort and merge, so nothing that grows with the input is broadcast; the
    window before it has the pieces in that order.
    """
    spark = pieces.sparkSession
    buckets = F.lit([-(-histogram.get(n, 0) // BUCKET_ROWS) or 1 for n in range(max(histogram, default=0) + 1)])
    hashed = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(buckets, F.col("length").cast("int") + 1))
    p = pieces.withColumn("bucket", hashed.cast("int"))
    counts = p.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")
    bases = materialize(counts.select(F.col("length").alias("of"), F.col("bucket").alias("at"), before.alias("base")), "piece-ranks")
    own = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = p.withColumn("own", own).join(bases.hint("merge"), (F.col("length") == F.col("of")) & (F.col("bucket") == F.col("at")))
    ranked = ranked.withColumn("rank", F.col("own") + F.col("base")).drop("own", "base", "of", "at", "bucket")
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(runs)
    names = [f.name for f in pieces.schema]

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        sequence, offset = locate(shared.value, *(batch.column(k).to_numpy() for k in ("length", "rank")))
        yield {k: batch.column(k) for k in names} | {"sequence_id": sequence, "offset": offset}

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return map_arrow(ranked, run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, planner=dominance_then_best_fit) -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` ids as the planner finds.

    A document is the ids of its text (null: empty) and the id EOD; a longer one is cut into full
    pieces, the first perhaps shorter. Returns doc_id, piece, start, length, ids_crc32,
    sequence_id and offset; the pieces of a sequence follow each other from 0 without
    gaps. Repeated rows are packed each for itself. An empty table gives no rows.
    """
    pieces = materialize(pieces_of(docs, path, capacity), "pieces")
    histogram = histogram_of(pieces)
    return place(pieces, planner(dict(histogram), capacity), histogram)


def id_kind(path: str) -> str:
    """Two bytes an id if the whole vocabulary fits, else four."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    top = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", ()))])
    return "<u2" if top < 1 << 16 else "<u4"


GROUP_BYTES = 32 << 20
MATRIX_ROWS = 2048


def write_matrices(docs: DataFrame, path: str, capacity: int = 2048, pad: int = 0, end: int = EOD) -> DataFrame:
    """Packed id matrices: one row per sequence, packed by best fit decreasing.

    Pieces are dealt by a hash of doc_id, piece and ids to groups of about GROUP_BYTES bytes
    of text, and a group is packed as a whole: how many groups and what is in each follows
    from the rows alone, so a rerun on another layout gives the same sequences, and a task
    holds one group. A group leaves at most one sequence less than half full.

    Returns sequence_id (group * 2 ** 32 + number), n_tokens, input_ids (binary: ``capacity``
    little-endian ids of ``id_bytes`` bytes, padded with ``pad``), id_bytes, cu_seqlens (0 and
    the ends of the segments, as attention kernels take them), position_resets (the places
    at which positions start again at 0: of each segment, and of the padding if there is
    any), doc_ids, pieces and starts (of each segment in its document). Nothing is lost:
    joining a document's pieces gives back all its ids. Null and empty texts are documents
    of ``end`` alone; repeated rows are packed each for itself; an empty table gives no
    rows. ``save_matrices`` writes them.
    """
    kind = id_kind(path)
    width = np.dtype(kind).itemsize
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).collect()[0][0] or 0
    groups = -(-total // GROUP_BYTES) or 1

    def ids_of(batch: pa.RecordBatch) -> Iterator[dict]:
        encode = encoder(path)
        out: dict[str, list] = {k: [] for k in ("row", "piece", "start", "crc", "ids")}
        size = 0
        for r, text in enumerate(batch.column(1)):
            ids = np.append(encode(text.as_py() or ""), np.uint32(end)).astype(kind)
            for p, (start, n) in enumerate(cuts(len(ids), capacity)):
                part = ids[start : start + n].tobytes()
                for k, v in (("row", r), ("piece", p), ("start", start), ("crc", zlib.crc32(part)), ("ids", part)):
                    out[k].append(v)
            size += len(ids)
            if size >= IDS_AT_ONCE or r + 1 == batch.num_rows:
                yield {"doc_id": batch.column(0).take(pa.array(out["row"], pa.int32())), **{k: v for k, v in out.items() if k != "row"}}
                out, size = {k: [] for k in out}, 0

    pieces = map_arrow(docs.select("doc_id", "text"), ids_of, f"doc_id {doc_kind}, piece int, start long, crc long, ids binary")
    pieces = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "crc"), F.lit(groups)))
    pieces = pieces.repartition(partitions(docs.sparkSession), "g").sortWithinPartitions("g", "doc_id", "piece", "crc")
    schema = f"sequence_id long, n_tokens int, input_ids binary, id_bytes int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<{doc_kind}>, pieces array<int>, starts array<long>"
    kinds = arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, size, made = [], None, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size, made
            for out in assemble(held, capacity, kind, pad):
                n = len(out["n_tokens"])
                yield to_batch(out | {"sequence_id": (group << 32) + made + np.arange(n), "id_bytes": np.full(n, width, np.int32)}, kinds)
                made += n
            held.clear()
            size = 0

        for batch in batches:
            for doc_id, p, start, ids, g in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "piece", "start", "ids", "g")), strict=True):
                if g != group or size >= GROUP_BYTES:  # equal rows are in one group, however many
                    yield from flush()
                    made = made if g == group else 0
                    group = g
                held.append((doc_id, p, start, np.frombuffer(ids, kind)))
                size += len(ids)
        yield from flush()

    return pieces.mapInArrow(run, schema)


def save_matrices(matrices: DataFrame, path: str) -> None:
    """Write matrices as Parquet files, in the order of sequence_id within each."""
    matrices.sortWithinPartitions("sequence_id").write.mode("overwrite").option("compression", "zstd").parquet(path)


def assemble(pieces: list[tuple], capacity: int, kind: str, pad: int) -> Iterator[dict]:
    """Pack pieces (doc_id, piece, start, ids) and lay them out, MATRIX_ROWS sequences at a time."""
    if not pieces:
        return
    length = np.array([len(p[3]) for p in pieces])
    sizes, counts = np.unique(length, return_counts=True)
    plan = best_fit_decreasing(dict(zip(sizes.tolist(), counts.tolist(), strict=True)), capacity)
    order = np.argsort(length, kind="stable")
    rank = np.empty(len(length), np.int64)
    rank[order] = np.arange(len(length)) - np.repeat(np.cumsum(counts) - counts, counts)
    sequence, offset = locate(np.array(sorted(plan.runs), np.int64), length, rank)
    order = np.lexsort((offset, sequence))
    bounds = np.searchsorted(sequence[order], np.arange(plan.sequences + 1))
    for lo in range(0, plan.sequences, MATRIX_ROWS):
        hi = min(lo + MATRIX_ROWS, plan.sequences)
        matrix = np.full((hi - lo, capacity), pad, kind)
        rows = [[pieces[i] for i in order[bounds[s] : bounds[s + 1]]] for s in range(lo, hi)]
        ends, resets = [], []
        for r, row in enumerate(rows):
            at = [0]
            for p in row:
                matrix[r, at[-1] : at[-1] + len(p[3])] = p[3]
                at.append(at[-1] + len(p[3]))
            ends.append(at)
            resets.append(at if at[-1] < capacity else at[:-1])
        yield {
            "n_tokens": [e[-1] for e in ends], "input_ids": [m.tobytes() for m in matrix], "cu_seqlens": ends,
            "position_resets": resets, "doc_ids": [[p[0] for p in row] for row in rows], "pieces": [[p[1] for p in row] for row in rows], "starts": [[p[2] for p in row] for row in rows],
        }


def locate(runs: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by length and rank; runs: sorted rows of a plan."""
    at = runs[np.searchsorted((runs[:, 0] << 44) + runs[:, 1], (length << 44) + rank, "right") - 1]
    i = rank - at[:, 1]
    return at[:, 3] + i // at[:, 4], at[:, 5] + i % at[:, 4] * length
