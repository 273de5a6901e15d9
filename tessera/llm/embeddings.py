"""Embedding near-duplicates by Euclidean p-stable hashing.

A vector of unit length is projected on Gaussian directions, shifted, and cut into steps
of ``WIDTH``; the ``PROJECTIONS`` steps of a table, with the label, name a bucket. Vectors
that share a bucket in any of ``TABLES`` tables are compared by their exact cosine in
double precision. At cosine 0.98 the distance is 0.2 and a projection keeps both in one
step with probability 0.84; all eight of a table with 0.25; some table of 32 with 0.9999.

Projections are sums of whole numbers below 2 ** 53 (components and directions are rounded
to ``GRID`` steps first), so they are the same in any order of summation and buckets need
not be sent along: who compares two vectors finds out anew which tables they share.

Equal vectors of a label are compared once, as one weighted vector with a number of its own.
Buckets of different tables with the same members are one. A bucket becomes blocks of
bounded size and every pair of its blocks is a task of its own, so a common bucket is
spread and no list of its pairs is made: a block counts links by matrix products, in the
first table that two vectors share, and hands on one link per component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import concat, map_arrow, materialize, mix, partitions, release, signed, stream

TABLES, PROJECTIONS, WIDTH = 32, 8, 1.0
BLOCK = 1024
GRID = 1 << 18


def directions(dimension: int, tables: int, projections: int, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions (dimension x tables * projections) and shifts in 0..1, as whole numbers of GRID steps; the same on every machine."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return np.rint(rng.standard_normal((dimension, tables * projections)) * GRID), rng.uniform(0, 1, tables * projections)


class Hashing:
    """Bucket keys of unit vectors: 64 bits per vector and table."""

    def __init__(self, tables: int, projections: int, width: float) -> None:
        self.tables, self.projections, self.width = tables, projections, width
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def keys(self, unit: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """labels: a number per vector that is equal for equal labels."""
        d = unit.shape[1]
        if d not in self.known:
            self.known[d] = directions(d, self.tables, self.projections)
        a, b = self.known[d]
        whole = np.rint(unit * GRID) @ a  # exact: each factor below 2 ** 21, sums below 2 ** 53 for some 2,000 components and more
        steps = np.floor(whole / (float(GRID) * GRID * self.width) + b).astype(np.int64).view(np.uint64).reshape(len(unit), self.tables, self.projections)
        keys = mix(stream(31, self.tables)[None, :] ^ mix(labels.astype(np.int64).view(np.uint64))[:, None])
        for p in range(self.projections):
            keys = mix(keys ^ steps[:, :, p]) + np.uint64(p + 1)
        return keys


def units(raw: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors of unit length in double precision from what ``_packed`` made of them: rows and their vectors, by dimension."""
    if not len(raw):
        return []
    bounds = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8)
    size, single = np.diff(bounds), data[bounds[1:] - 1] == ord("f")
    parts: dict[int, list] = {}
    for n, f in sorted(set(zip(size.tolist(), single.tolist(), strict=True))):
        rows = np.flatnonzero((size == n) & (single == f))
        x = data[bounds[rows][:, None] + np.arange(n - 1)].view(np.float32 if f else np.float64).astype(float)
        x = x / np.abs(x).max(1, keepdims=True)
        parts.setdefault(x.shape[1], []).append((rows, x / np.sqrt((x * x).sum(1, keepdims=True))))
    return [(np.concatenate([r for r, _ in p]), np.concatenate([x for _, x in p])) for p in parts.values()]


def _packed(batch: pa.RecordBatch) -> Iterator[dict]:
    """The vector as bytes, in single precision if that says the same (last byte f, else d); null if it can't be compared."""
    vectors = batch.column("embedding")
    size = np.array([len(v) if v.is_valid else 0 for v in vectors])
    valid = batch.column("label").is_valid().to_numpy(zero_copy_only=False) & batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
    raw: list[bytes | None] = [None] * len(size)
    for d in np.unique(size[(size > 0) & valid]):
        rows = np.flatnonzero(valid & (size == d))
        x = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)  # null: NaN
        x = x + 0.0  # one zero
        good = np.isfinite(x).all(1) & (x != 0).any(1)
        with np.errstate(over="ignore"):
            single = x.astype(np.float32)
        short = (single == x).all(1)
        for i in np.flatnonzero(good):
            raw[rows[i]] = single[i].tobytes() + b"f" if short[i] else x[i].tobytes() + b"d"
    yield {"vec_id": batch.column("vec_id"), "label": batch.column("label"), "raw": pa.array(raw, pa.binary())}


def _slots(tables: int, projections: int, width: float):
    hashing: list[Hashing] = []

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        hashing[:] = hashing or [Hashing(tables, projections, width)]
        label, number = batch.column("lab").to_numpy(), batch.column("v").to_numpy()
        for rows, unit in units(batch.column("raw")):
            keys = hashing[0].keys(unit, label[rows])
            yield {"v": np.repeat(number[rows], tables), "t": np.tile(np.arange(tables, dtype=np.int8), len(rows)), "key": signed(keys.reshape(-1))}

    return run


class Block:
    """Vectors of one dimension that share a bucket; their keys are made when two of them are near."""

    def __init__(self, number: np.ndarray, weight: np.ndarray, label: np.ndarray, name: np.ndarray, unit: np.ndarray, hashing: Hashing) -> None:
        self.number, self.weight, self.label, self.name, self.unit, self.hashing, self._keys = number, weight, label, name, unit, hashing, None

    def keys(self) -> np.ndarray:
        if self._keys is None:
            self._keys = self.hashing.keys(self.unit, self.label)
        return self._keys


def compare(a: Block, b: Block, t: int, least: float) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """Links of two blocks (or of one with itself) that share the bucket of table t and no earlier one.

    Returns the weighted number of links of each vector and links that join what is linked.
    """
    same = a is b
    counts = [np.zeros(len(a.unit), np.int64), np.zeros(len(b.unit), np.int64)]
    shift = 0 if same else len(a.unit)
    label = np.arange(len(a.unit) + len(b.unit))
    edges: list[tuple[int, int]] = []
    for i in range(0, len(a.unit), 256):
        hit = a.unit[i : i + 256] @ b.unit.T >= least
        if same:
            hit &= np.arange(i, i + len(hit))[:, None] < np.arange(len(b.unit))[None, :]
        hit &= a.name[i : i + 256, None] == b.name[None, :]  # labels whose numbers are equal by chance
        at, to = np.nonzero(hit)
        if not len(at):
            continue
        cuts = np.searchsorted(at, np.arange(len(hit) + 1))
        new = np.ones(len(at), bool)
        for before in range(t):
            new &= a.keys()[at + i, before] != b.keys()[to, before]
        counts[0] += np.bincount(at[new] + i, b.weight[to[new]], len(a.unit)).astype(np.int64)
        counts[1] += np.bincount(to[new], a.weight[at[new] + i], len(b.unit)).astype(np.int64)
        for x in np.flatnonzero(np.diff(cuts)):
            others = to[cuts[x] : cuts[x + 1]] + shift
            others = others[label[others] != label[i + x]]
            while len(others):
                edges.append((int(a.number[i + x]), int(b.number[others[0] - shift])))
                label[label == label[others[0]]] = label[i + x]
                others = others[label[others] != label[i + x]]
    return counts, edges


SMALL = 8  # members of a bucket whose pairs are compared one by one, with those of other small buckets at once
ROWS = 8192


def _compare(least: float, tables: int, projections: int, width: float):
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def rows_of(a: np.ndarray, b: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b), pa.array(n)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = Hashing(tables, projections, width)

        def small(rows: pa.RecordBatch, cut: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Links within small buckets."""
            number, weight, label, t = (rows.column(k).to_numpy() for k in ("v", "copies", "lab", "t"))
            name = rows.column("name").dictionary_encode().indices.to_numpy()
            pairs = [np.stack([cut[size == k] + i, cut[size == k] + j], 1) for k in range(2, SMALL + 1) for i in range(k) for j in range(i + 1, k)]
            pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
            for of, unit in units(rows.column("raw")):
                place = np.full(len(number), -1)
                place[of] = np.arange(len(of))
                p = pairs[(place[pairs] >= 0).all(1)]
                for lo in range(0, len(p), ROWS):
                    q = p[lo : lo + ROWS]
                    x = place[q]
                    q = q[(np.einsum("ij,ij->i", unit[x[:, 0]], unit[x[:, 1]]) >= least) & (name[q[:, 0]] == name[q[:, 1]])]
                    if not len(q):
                        continue
                    near = np.unique(q)
                    keys = hashing.keys(unit[place[near]], label[near])
                    earlier = (keys[np.searchsorted(near, q[:, 0])] == keys[np.searchsorted(near, q[:, 1])]) & (np.arange(tables) < t[q[:, 0], None])
                    q = q[~earlier.any(1)]
                    a, b = number[q[:, 0]], number[q[:, 1]]
                    yield rows_of(a, b, np.zeros(len(a), np.int64))
                    yield rows_of(a, None, weight[q[:, 1]])
                    yield rows_of(b, None, weight[q[:, 0]])

        def large(rows: pa.RecordBatch, key: tuple) -> Iterator[pa.RecordBatch]:
            """Links within a block, or between two."""
            side, number, weight, label = (rows.column(k).to_numpy() for k in ("side", "v", "copies", "lab"))
            name = rows.column("name").dictionary_encode().indices.to_numpy()
            t, i, j = key[1:]
            for of, unit in units(rows.column("raw")):  # vectors of one dimension only are compared
                sides = [side[of] == 0, side[of] == 1] if i != j else [np.ones(len(of), bool)]
                if not all(s.any() for s in sides):
                    continue
                blocks = [Block(number[of[s]], weight[of[s]], label[of[s]], name[of[s]], unit[s], hashing) for s in sides]
                counts, edges = compare(blocks[0], blocks[-1], t, least)
                for block, c in zip((blocks[0], blocks[-1]), counts, strict=True):
                    yield rows_of(block.number[c > 0], None, c[c > 0])
                if edges:
                    yield rows_of(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]), np.zeros(len(edges), np.int64))

        def settle(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            cols = [rows.column(k).to_numpy() for k in ("key", "t", "i", "j")]
            cut = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)]))
            size = np.diff(np.append(cut, rows.num_rows))
            few = (size <= SMALL) & (cols[2][cut] == cols[3][cut])
            yield from small(rows, cut[few], size[few])
            for lo, n in zip(cut[~few].tolist(), size[~few].tolist(), strict=True):
                yield from large(rows.slice(lo, n), tuple(int(c[lo]) for c in cols))

        held: list[pa.RecordBatch] = []
        waiting, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy() for k in ("key", "t", "i", "j")]
            if waiting >= ROWS:
                other = np.flatnonzero(np.any([c != v for c, v in zip(cols, last, strict=True)], axis=0))
                if len(other):  # the bucket that is open ends here
                    yield from settle(concat([*held, batch.slice(0, int(other[0]))] if other[0] else held))
                    held, waiting, batch = [], 0, batch.slice(int(other[0]))
            held.append(batch)
            waiting += batch.num_rows
            last = [c[-1] for c in cols]
        if held:
            yield from settle(concat(held))

    return run


def near_vectors(vectors: DataFrame, least: float = 0.98, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH) -> DataFrame:
    """Link vectors of equal label with a cosine of at least ``least``.

    Returns one row per row of ``vectors``: vec_id, n_links (other vectors linked
    directly), component_id (the smallest vec_id that links reach) and kept. vec_id and
    label may be of any type that can be grouped; labels are equal as Spark compares them.
    Vectors without label or vec_id, null, empty or zero vectors and those with a null, NaN
    or infinite component link with nothing, nor do vectors of different lengths with each
    other. Rows that repeat a vec_id are vectors of their own. An empty table gives no
    rows; other columns are not read.
    """
    spark = vectors.sparkSession
    v = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    types = {f.name: f.dataType.simpleString() for f in v.schema}
    packed = map_arrow(v, _packed, f"vec_id {types['vec_id']}, label {types['label']}, raw binary")
    # distinct vectors of a label, numbered; a label's name is its value as text, its number a hash of that
    name = F.to_json(F.struct(F.col("label")))
    reps = packed.where("raw is not null").groupBy("label", "raw").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    reps = reps.select(F.monotonically_increasing_id().alias("v"), "label", name.alias("name"), F.xxhash64(name).alias("lab"), "raw", "least", "copies")
    reps = materialize(reps, "distinct-vectors")
    slots = map_arrow(reps.select("v", "lab", "raw"), _slots(tables, projections, width), "v long, t tinyint, key long")
    shared = slots.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("k"), "n")
    member = materialize(slots.join(shared, F.col("key") == F.col("k")).select("v", "t", "key", "n"), "bucket-members")
    # of buckets with the same members (by number and two sums over them) the one of the first table stays
    x = F.xxhash64("v")
    sums = member.groupBy("key").agg(F.first("t").alias("t"), F.first("n").alias("n"), F.bit_xor(x).alias("x"), F.bit_xor(F.xxhash64(x)).alias("y"))
    kept = sums.groupBy("n", "x", "y").agg(F.min(F.struct("t", "key")).alias("b")).select(F.col("b.key").alias("k"), F.ceil(F.col("n") / BLOCK).cast("int").alias("n_blocks"))
    kept = materialize(kept, "buckets")
    member = member.join(kept, F.col("key") == F.col("k")).select("v", "t", "key", "n_blocks", F.pmod(F.xxhash64("v", F.lit(1)), F.col("n_blocks")).cast("int").alias("block"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda o: F.struct(F.least(o, "block").alias("i"), F.greatest(o, "block").alias("j"), (F.col("block") > o).cast("int").alias("side")))
    member = member.select("v", "t", "key", F.explode(pairs).alias("p")).select("v", "t", "key", "p.i", "p.j", "p.side")
    full = member.join(reps.select(F.col("v").alias("r"), "lab", "name", "raw", "copies"), F.col("v") == F.col("r")).drop("r")
    place = ("key", "t", "i", "j")
    found = full.repartition(partitions(spark), *place).sortWithinPartitions(*place).mapInArrow(_compare(least, tables, projections, width), "a long, b long, n long")
    found = materialize(found, "vector-links")
    release(kept)
    joined = materialize(components(found.where("b is not null")), "vector-components")
    # what links say of a distinct vector: its links and the smallest vec_id of its component
    links = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("n")).select(F.col("a").alias("linked"), "n")
    linked = reps.select("v", "label", "raw", "least", "copies").join(links, F.col("v") == F.col("linked"), "left").where("linked is not null or copies > 1")
    linked = linked.join(joined, F.col("v") == F.col("id"), "left").withColumn("c", F.coalesce("component", "v"))
    smallest = linked.groupBy("c").agg(F.min("least").alias("smallest")).withColumnRenamed("c", "of")
    told = linked.join(smallest, F.col("c") == F.col("of")).select(F.col("label").alias("rl"), F.unhex(F.sha2("raw", 256)).alias("rh"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), "smallest")
    told = materialize(told, "linked-vectors")
    release(joined)
    rows = packed.select("vec_id", "label", F.unhex(F.sha2("raw", 256)).alias("h"))
    rows = rows.join(told, (F.col("label") == F.col("rl")) & (F.col("h") == F.col("rh")), "left")
    out = rows.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("smallest", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
