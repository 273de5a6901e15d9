"""MinHash near-duplicates with SuperMinHash signatures.

SuperMinHash gives each element of a set one permutation of the m slots and puts rank
plus a fraction in the slots in that order; a slot keeps its least value. Ranks of one
element are distinct, so slots are correlated and the estimate has a lower variance
than independent hashes. A set stops once no slot can fall below the next rank: with n
elements after about m ln(m) / n ranks.

Signatures are cut into bands; sets that share a band are candidates. Candidate groups
are cut into blocks of bounded size; within a block the full shingle sets of pairs that
share a band are compared unless links found so far join them already. Blocks of one
large group share pivots, and what the pivots leave over is compared with every block,
so no link between components is lost and no list of all pairs is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import column_bytes, map_arrow, materialize, mix, partitions, powers, release, signed, slices, stream, word_hashes, words

BANDS, ROWS = 24, 6
BLOCK, PIVOTS = 512, 8
_NONE = np.uint64(2**64 - 1)
_ODD = 0xD6E8FEB86659FD93


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, concatenated, and their n + 1 offsets.

    A text with fewer than ``width`` words has its whole sequence as one shingle; one
    without words has none.
    """
    starts, ends, first = words(buf, offsets)
    h = word_hashes(buf, starts, ends)
    n_words = np.diff(first)
    weights = powers(_ODD, width + 1)[1:]
    rolled = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for i in range(width):
        rolled += h[i : i + len(rolled)] * weights[i]
    rolled = mix(rolled)
    out, sizes = [], np.zeros(len(n_words), np.int64)
    for d, n in enumerate(n_words):
        if n >= width:
            s = np.unique(rolled[first[d] : first[d + 1] - width + 1])
        elif n:
            s = mix((h[first[d] : first[d + 1]] * weights[:n]).sum(keepdims=True, dtype=np.uint64) ^ np.uint64(n))
        else:
            continue
        sizes[d] = len(s)
        out.append(s)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def superminhash(elements: np.ndarray, offsets: np.ndarray, m: int) -> np.ndarray:
    """Signatures (sets x m) of concatenated sets; an empty set has the largest word in every slot.

    All elements take their rank-j step together. Slot k of step j is drawn from j..m-1
    and read through the swaps of the element's earlier steps.
    """
    n = len(offsets) - 1
    out = np.full(n * m, _NONE, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    seeds = stream(4242, m)
    swaps: list[np.ndarray] = []
    for j in range(m):
        if not len(elements):
            break
        x = mix(elements ^ seeds[j])
        k = ((x >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64) + j
        slot = k
        for i in range(j - 1, -1, -1):
            slot = np.where(slot == swaps[i], i, np.where(slot == i, swaps[i], slot))
        np.minimum.at(out, owner * m + slot, (np.uint64(j) << np.uint64(32)) | (x & np.uint64(0xFFFFFFFF)))
        unsettled = out.reshape(n, m).max(axis=1) >= np.uint64(j + 1) << np.uint64(32)
        on = unsettled[owner]
        elements, owner = elements[on], owner[on]
        swaps = [s[on] for s in swaps] + [k[on]]
    return out.reshape(n, m)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; equal keys of different bands do not occur by design of the seeds."""
    parts = signatures.reshape(len(signatures), bands, rows)
    keys = np.broadcast_to(stream(99, bands), (len(signatures), bands)).copy()
    for r in range(rows):
        keys = mix(keys ^ parts[:, :, r]) + np.uint64(r + 1)
    return keys


def _signatures(width: int, bands: int, rows: int):
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        data, offsets = column_bytes(batch.column(1))
        for i, j in slices(offsets):
            buf, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            elements, at = shingle_sets(buf, off, width)
            keys = band_keys(superminhash(elements, at, bands * rows), bands, rows)
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(elements ^ np.uint64(s)))]) for s in (11, 12)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) * bands + 1, bands, dtype=np.int32)), pa.array(signed(keys.reshape(-1))))
            yield {"doc_id": batch.column(0).slice(i, j - i), "n": np.diff(at), "d1": signed(sums[0][at[1:]] - sums[0][at[:-1]]), "d2": signed(sums[1][at[1:]] - sums[1][at[:-1]]), "bands": lists}

    return run


def _sets(width: int):
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        data, offsets = column_bytes(batch.column("text"))
        for i, j in slices(offsets):
            elements, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
            raw = [elements[at[d] : at[d + 1]].tobytes() for d in range(j - i)]
            yield {k: batch.column(k).slice(i, j - i) for k in ("doc_id", "group", "n_blocks", "pivot", "bands")} | {"shingles": pa.array(raw, pa.binary())}

    return run


def link_block(ids: np.ndarray, sets: list[np.ndarray], bands: np.ndarray, labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join the labels of a block: pairs that share a band and whose sets have 100 * intersection >= percent * union."""
    label = np.unique(labels, return_inverse=True)[1]
    size = np.array([len(s) for s in sets])
    links, tested = [], set()
    for b in range(bands.shape[1]):
        order = np.argsort(bands[:, b], kind="stable")
        keys = bands[order, b]
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        for c in np.flatnonzero(np.diff(cuts) > 1):
            members = order[cuts[c] : cuts[c + 1]]
            for t, i in enumerate(members[:-1]):
                rest = members[t + 1 :]
                rest = rest[label[rest] != label[i]]
                rest = rest[100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])]
                for j in rest:
                    pair = (i, j) if i < j else (j, i)
                    if label[i] == label[j] or pair in tested:
                        continue
                    tested.add(pair)
                    both = sets[i][np.searchsorted(sets[i], sets[j]).clip(max=size[i] - 1)] == sets[j]
                    shared = int(both.sum())
                    if 100 * shared >= percent * (size[i] + size[j] - shared):
                        links.append((int(ids[i]), int(ids[j])))
                        label[label == label[j]] = label[i]
    return links


def _linker(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        kinds = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def flush() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            ids = np.array([r[0] for r in held])
            found = link_block(ids, [r[1] for r in held], np.stack([r[2] for r in held]), np.array([r[3] for r in held]), percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], schema=kinds)

        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("group", "block", "chunk", "doc_id", "label")]
            raw, bands = batch.column("shingles"), batch.column("bands")
            width = len(bands.flatten()) // max(1, len(bands))
            flat = bands.flatten().to_numpy().reshape(-1, width)
            for r in range(batch.num_rows):
                k = (cols[0][r], cols[1][r], cols[2][r])
                if k != key:
                    yield from flush()
                    key, held = k, []
                held.append((cols[3][r], np.frombuffer(raw[r].as_buffer(), np.uint64).copy(), flat[r].copy(), cols[4][r]))
        yield from flush()

    return run


def _link(rows: DataFrame, percent: int) -> DataFrame:
    n = partitions(rows.sparkSession)
    keys = ("group", "block", "chunk")
    return rows.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(_linker(percent), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of documents whose word-shingle sets have a Jaccard similarity of at least percent / 100.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Returns one row per row of
    ``docs``: doc_id, n_shingles, component_id (the smallest doc_id that links reach) and
    kept (it is its own). Documents with equal sets are linked through one representative.
    Empty and null texts have no shingles and link with nothing; a row without doc_id
    links with nothing and has no component. Rows that repeat a doc_id are one node. An
    empty table gives no rows; other columns of ``docs`` are not read.

    A pair at exactly the threshold shares one of the 24 bands of 6 slots with
    probability 0.9993, one at 0.9 with more than 1 - 1e-7.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sig = materialize(map_arrow(docs, _signatures(width, bands, rows), "doc_id long, n long, d1 long, d2 long, bands array<long>"), "signatures")
    reps = sig.where("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    reps = materialize(reps, "distinct-sets")
    links = _verified(docs, reps, width, percent)
    found = components(links)
    r = reps.select(F.col("n").alias("rn"), F.col("d1").alias("r1"), F.col("d2").alias("r2"), "rep")
    rows_ = sig.select("doc_id", "n", "d1", "d2").join(r, (F.col("n") == F.col("rn")) & (F.col("d1") == F.col("r1")) & (F.col("d2") == F.col("r2")), "left")
    rows_ = rows_.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"))
    out = rows_.join(found, F.col("rep") == F.col("id"), "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _verified(docs: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between representatives that join their components, each confirmed on full sets."""
    banded = reps.select("rep", F.explode("bands").alias("key"))
    heads = materialize(banded.groupBy("key").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("head_key"), "head"), "buckets")
    stars = banded.join(heads, F.col("key") == F.col("head_key")).where("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b"))
    candidate = components(stars)
    release(heads)
    grouped = materialize(candidate.union(candidate.select(F.col("component").alias("id"), "component").distinct()), "candidates")
    sizes = grouped.groupBy("component").count().where(F.col("count") > BLOCK).select(F.col("component").alias("c"), "count")
    sizes = materialize(sizes, "large-groups")
    n_blocks = F.coalesce(F.ceil(F.col("count") / BLOCK), F.lit(1)).cast("int")
    pivot = F.coalesce((F.col("id") == F.col("component")) | (F.pmod(F.xxhash64(F.lit("pivot"), "id"), F.col("count")) < PIVOTS), F.lit(False))
    member = grouped.join(sizes, F.col("component") == F.col("c"), "left").select("id", F.col("component").alias("group"), n_blocks.alias("n_blocks"), pivot.alias("pivot"))
    member = member.join(reps.select("rep", "bands"), F.col("id") == F.col("rep")).drop("rep")
    wanted = docs.where("doc_id is not null").join(member, F.col("doc_id") == F.col("id")).select("doc_id", "group", "n_blocks", "pivot", "bands", "text")
    sets = materialize(map_arrow(wanted, _sets(width), "doc_id long, group long, n_blocks int, pivot boolean, bands array<long>, shingles binary"), "sets")
    own = F.pmod(F.xxhash64("doc_id"), F.col("n_blocks")).cast("int")
    spread = F.when(F.col("pivot") & (F.col("n_blocks") > 1), F.sequence(F.lit(0), F.col("n_blocks") - 1)).otherwise(F.array(own))
    blocks = sets.select("*", F.explode(spread).alias("block"), F.lit(0).alias("chunk"), F.col("doc_id").alias("label"))
    links = materialize(_link(blocks, percent), "links-in-blocks")
    across = [] if sizes.isEmpty() else [_across(sets, components(links), own, percent)]
    release(sets, sizes, grouped)
    return links.union(across[0]) if across else links


def _across(sets: DataFrame, found: DataFrame, own, percent: int) -> DataFrame:
    """Links of large groups that cross blocks and that the pivots did not find.

    The members outside the largest component of their group are compared, in chunks,
    with every block of it.
    """
    large = sets.where("n_blocks > 1")
    labels = large.select("doc_id", "group", "n_blocks").join(found, F.col("doc_id") == F.col("id"), "left").select("doc_id", "group", "n_blocks", F.coalesce("component", "doc_id").alias("label"))
    labels = materialize(labels.distinct(), "labels")
    main = labels.groupBy("group", "label").count().groupBy("group").agg(F.max_by("label", F.struct("count", "label")).alias("main")).select(F.col("group").alias("g"), "main")
    main = materialize(main, "main-components")
    rest = labels.join(main, F.col("group") == F.col("g")).where("label <> main")
    chunks = materialize(rest.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n_chunks")).select(F.col("group").alias("cg"), "n_chunks"), "chunks")
    if chunks.isEmpty():
        return found.select(F.col("id").alias("a"), F.col("component").alias("b"))
    labelled = labels.join(main, F.col("group") == F.col("g")).join(chunks, F.col("group") == F.col("cg")).select(F.col("doc_id").alias("l_id"), "label", (F.col("label") != F.col("main")).alias("left_over"), "n_chunks")
    rows = large.join(labelled, F.col("doc_id") == F.col("l_id"))
    each = F.sequence(F.lit(0), F.col("n_chunks") - 1)
    as_member = rows.select("*", own.alias("block"), F.explode(each).alias("chunk"))
    as_rest = rows.where("left_over").select("*", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), F.pmod(F.xxhash64(F.lit("chunk"), "doc_id"), F.col("n_chunks")).cast("int").alias("chunk"))
    return materialize(_link(as_member.union(as_rest), percent), "links-across")
