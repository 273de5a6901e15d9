"""What the operators of this package share: durable cuts of the lineage and a byte-level text kernel.

Durable cuts: ``materialize`` writes a table to the folder in ``spark.checkpoint.dir``
(all executors see it) and reads it back, so a lost executor costs the tasks that were
running and never a recomputation of an earlier stage. Shuffle files of the write are
released when it ends. Tables are removed with ``release`` or when the driver exits.

Text kernel: texts stay in Arrow's UTF-8 buffers; words, shingles and windows are
computed with array arithmetic over slices of a quarter megabyte, so memory is bounded by
the slice or, if larger, by the longest single text.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SLICE_BYTES = 1 << 18
BATCH_ROWS = 4096
ROWS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_tables: dict[str, SparkSession] = {}
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Where none is named a temporary one serves, but only on a single machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir is not set: executors have no folder in common")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="tessera-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the result has a short lineage and a known size."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if not _tables:
        atexit.register(_remove_all)
    _tables[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def small_batches(spark: SparkSession) -> None:
    """Let a Python worker get at most BATCH_ROWS rows at once; a batch of whole texts is what a worker's memory depends on most."""
    rows = int(spark.conf.get(ROWS_PER_BATCH))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set(ROWS_PER_BATCH, str(BATCH_ROWS))


def release(*frames: DataFrame) -> None:
    """Delete materialized tables that no later step reads."""
    for df in frames:
        path = getattr(df, "_tessera_path", None)
        spark = _tables.pop(path, None)
        if spark is not None:
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove_all() -> None:
    for path, spark in list(_tables.items()):
        try:
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)
        except Exception:  # the JVM may have ended first; the cluster expires its checkpoint folder
            break
    _tables.clear()


def give_back() -> None:
    """Return the freed memory of this process to the system: Arrow's pool and the C library keep what they once took, and a driver goes on for long after it has learnt a model."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
    if trim is not None:
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- array arithmetic on 64-bit words ----------------------------------------------------

_C1, _C2, _GOLD = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random words of a seed."""
    return mix(np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * _GOLD)


_BASE = 0x2545F4914F6CDD1D
_BASE_INV = pow(_BASE, -1, 1 << 64)
_TABLE = stream(77, 256)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_TABLE = _TABLE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 4096)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


# --- texts of an Arrow batch --------------------------------------------------------------


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)):
        col = col.cast(pa.large_binary() if pa.types.is_binary(col.type) else pa.large_string())
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_large_binary(col.type) else "")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, budget: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``budget`` bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + budget, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of the rows, and the first word of each row (n + 1)."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[buf]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    cuts = offsets[(offsets < len(buf)) & (offsets >= 0)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes, with A-Z lower-cased."""
    n = len(buf)
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER_TABLE if lower else _TABLE)[buf] * powers(_BASE, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_BASE_INV, n)[starts] + (ends - starts).astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# --- streams of sorted rows -----------------------------------------------------------------


def concat(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def arrow_schema(df_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df_schema)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow with a function from a batch to dicts of columns."""
    from pyspark.sql.types import StructType

    kinds = arrow_schema(StructType.fromDDL(schema))
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for out in f(batch):
                    yield to_batch(out, kinds)

    return df.mapInArrow(run, schema)


def to_batch(columns: dict, kinds: pa.Schema) -> pa.RecordBatch:
    arrays = [x if isinstance(x, pa.Array) and x.type == k.type else pa.array(x, k.type) for k, x in ((k, columns[k.name]) for k in kinds)]
    return pa.RecordBatch.from_arrays(arrays, schema=kinds)
