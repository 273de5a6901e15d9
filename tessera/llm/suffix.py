"""Suffix-array deduplication of substrings over a collection of documents.

Finding. A string of LENGTH bytes contains LENGTH - SEED + 1 seeds (substrings of SEED
bytes); the leftmost with the least hash is its anchor. Equal strings have equal anchors.
Neighbouring strings of a text share their anchor, so one segment of at most
2 * LENGTH - SEED bytes holds all strings of an anchor, and every string is in one segment
only. Of the bytes that a string has besides its anchor at least half lie on one side of it,
so only segments go on whose anchor has in two documents equal bytes on a side, told by a
small fingerprint.

Comparing. The segments of the anchors of a batch form a collection whose suffix array is
built column by column: each round inserts one symbol of every segment, from the last to the
first, and updates the collection's Burrows-Wheeler transform and the common prefixes of
neighbours. Both are files that a round reads and writes from front to back, in blocks; what
stays in memory is one position per segment. (Applied to whole texts the method needs as
many rounds as the longest text has bytes; segments bound the rounds without losing a
string.) A segment that several rows have, byte by byte, is one entry of the collection with
its documents. Suffixes whose common prefix reaches LENGTH are equal strings, and the
smallest doc_id among their owners says which of the others are removed.

Applying. Removed intervals go back to their documents, where their union is cut out.

Frequent passages. What a task has in common with itself does not cross the network: of equal
anchors with equal sides a task sends two to their partition and spreads the others, already
known to be shared; of byte-equal segments it sends that of its smallest document (a task has
its documents in order), and those of the others are removed as repeats of it. So a passage
in every document costs a partition a few rows a task. An anchor with more distinct segments
than a collection takes is split by wider contexts: equal strings agree in half of what is
left of them on one side, so the collections of equal halves find them, and halves of halves
if need be.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from .shared import _BASE, _BASE_INV, _TABLE, SLICE_BYTES, arrow_schema, column_bytes, map_arrow, materialize, mix, partitions, powers, release, signed, slices, to_batch

LENGTH, SEED = 50, 16
BLOCK = 1 << 18  # entries of a file that are in memory at once
SPOOL = 1 << 20  # bytes of a column that stay in memory
BATCH = 1 << 16  # strings of a collection at most
SENT = 1 << 20  # anchors that a task remembers to have sent
SEEN = 1 << 18  # segments that a task remembers to have sent
LONG = 1 << 20  # bytes of a text that are looked at at once
NO_SIDE, SHARED = 255, 0xFEFE
_POSITION = 31
_OWNER = 7  # bits of a place in a segment


def prefix_hashes(buf: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any substring follows."""
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLE[buf] * powers(_BASE, len(buf)), out=sums[1:])
    return sums


def substring_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(_BASE_INV, len(sums))[start])


def anchors(sums: np.ndarray, offsets: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of all strings of ``length`` bytes within the texts: place, hash, and the first and last start of its strings; sums: of the texts' bytes.

    The upper half of a hash decides and then the place, in texts of any size alike.
    """
    n, w = len(sums) - 1, length - seed + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = mix((sums[seed:] - sums[:-seed]) * powers(_BASE_INV, n)[: n - seed + 1])
    low = np.uint64(0xFFFFFFFF)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    have = 1
    while have < w:
        step = min(have, w - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    inside = np.ones(len(least), bool)  # strings that do not cross the end of a text
    for e in offsets[1:-1]:
        inside[max(0, e - length + 1) : e] = False
    inside[max(0, offsets[-1] - length + 1) :] = False
    start = np.flatnonzero(inside)
    at = (least[start] & low).astype(np.int64)
    if not len(at):
        return at, np.zeros(0, np.uint64), at, at
    cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[cut], hashes[at[cut]], start[cut], start[np.append(cut[1:], len(at)) - 1]


class Sent:
    """Which anchors with their sides a task has sent to their partition: from one document, or from two."""

    def __init__(self) -> None:
        self.key, self.doc, self.two = np.zeros(SENT, np.uint64), np.zeros(SENT, np.int64), np.zeros(SENT, bool)

    def spread(self, key: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether a row need not go to its partition, as two documents with its key have gone there."""
        order = np.argsort(key, kind="stable")
        k, d = key[order], doc[order]
        cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(cut, len(k)))
        slot = (k[cut] % np.uint64(SENT)).astype(np.int64)
        known = self.key[slot] == k[cut]
        done = known & self.two[slot]
        one = np.where(known, self.doc[slot], d[cut])
        other = d != np.repeat(one, size)
        two = np.logical_or.reduceat(other, cut)
        second = np.zeros(len(k), bool)
        at = np.flatnonzero(other)
        group = np.repeat(np.arange(len(cut)), size)[at]
        second[at[np.concatenate([[True], group[1:] != group[:-1]])] if len(at) else at] = True
        goes = second
        goes[cut[~known]] = True
        goes = np.where(np.repeat(two, size), goes, True) & ~np.repeat(done, size)
        self.key[slot], self.doc[slot], self.two[slot] = k[cut], one, done | two
        out = np.empty(len(k), bool)
        out[order] = ~goes
        return out


def _anchor_rows(length: int, seed: int):
    sent: list[Sent] = []

    def rows(buf: np.ndarray, off: np.ndarray, doc: np.ndarray, crc: np.ndarray, shift: int, within: tuple[int, int] | None) -> Iterator[dict]:
        sums = prefix_hashes(buf)
        at, h, first, last = anchors(sums, off, length, seed)
        if within is not None:  # starts of strings that this part of a long text answers for
            first, last = np.maximum(first, within[0]), np.minimum(last, within[1] - 1)
            mine = first <= last
            at, h, first, last = at[mine], h[mine], first[mine], last[mine]
        if not len(at):
            return
        row = np.searchsorted(off, at, "right") - 1
        sides = side_marks(sums, off, at, row, length, seed)
        key = (h & ~np.uint64(0xFFFF)) | sides.astype(np.uint64)  # 48 bits tell anchors apart well enough to group them
        place = (crc[row] << _POSITION) | (first - off[row] + shift)
        aside = sent[0].spread(key, doc[row])
        key[aside] = (mix(place[aside].view(np.uint64) ^ mix(doc[row[aside]].view(np.uint64))) & ~np.uint64(0xFFFF)) | np.uint64(SHARED)
        yield {"h": signed(key), "doc_id": doc[row], "place": place, "win": ((at - first) << 6 | (last - first)).astype(np.int32)}

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        sent[:] = sent or [Sent()]
        data, offsets = column_bytes(batch.column("text"))
        doc, crc = batch.column("doc_id").to_numpy(), batch.column("crc").to_numpy()
        for i, j in slices(offsets, min(SLICE_BYTES, LONG)):
            n = offsets[j] - offsets[i]
            if n <= LONG:
                yield from rows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], doc[i:j], crc[i:j], 0, None)
                continue
            for c in range(0, n, LONG):  # one long text
                lo, hi = max(0, c - length), min(n, c + LONG + 3 * length)
                yield from rows(data[offsets[i] + lo : offsets[i] + hi], np.array([0, hi - lo]), doc[i:j], crc[i:j], lo, (c - lo, c - lo + LONG))

    return run


def side_marks(sums: np.ndarray, offsets: np.ndarray, at: np.ndarray, row: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Of each anchor a mark of the bytes before it and after it (NO_SIDE: the text has too few), as one number; never SHARED."""
    half = (length - seed + 1) // 2
    out = np.zeros(len(at), np.int32)
    for start, end in ((at - half, at), (at + seed, at + seed + half)):
        fits = (start >= offsets[row]) & (end <= offsets[row + 1])
        mark = substring_hashes(sums, np.where(fits, start, 0), np.where(fits, end, 0)) % np.uint64(NO_SIDE - 1)
        out = out * 256 + np.where(fits, mark.astype(np.int32), NO_SIDE)
    return out


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by h (anchor and marks of its sides): those whose anchor, with the bytes on a side of it, occurs in two documents or more.

    Rows marked SHARED are known to be. An anchor that goes on in the next batch is judged
    without its sides and passed through, so no anchor is ever held as a whole.
    """
    kinds = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("win", pa.int32())])
    held: list[tuple] = []  # rows of the last anchor, as long as all are of one document
    last, shared = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        packed, doc, place, win = (batch.column(k).to_numpy() for k in ("h", "doc_id", "place", "win"))
        known = (packed & 0xFFFF) == SHARED
        out = []
        if known.any():
            out.append((doc[known], place[known], win[known]))
            packed, doc, place, win = packed[~known], doc[~known], place[~known], win[~known]
        if len(packed):
            h, sides = packed >> 16, packed & 0xFFFF
            cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.diff(np.append(cut, len(h)))
            many = np.minimum.reduceat(doc, cut) != np.maximum.reduceat(doc, cut)
            inner = many.copy()
            inner[-1] = False
            if last is not None and h[0] == last[0]:
                inner[0] = False
                shared = bool(shared or many[0] or doc[0] != last[1])
                if shared:
                    out, held = [*out, *held], []
                many[0] = shared
            else:
                held, shared = [], bool(many[0])
            keep = np.repeat(many, size)
            rows = np.flatnonzero(np.repeat(inner, size))
            if len(rows):
                keep[rows] = _side_in_two(np.repeat(np.arange(len(cut)), size)[rows], doc[rows], sides[rows])
            out.append((doc[keep], place[keep], win[keep]))
            if len(cut) > 1:
                held = []
            shared = bool(many[-1])
            if not shared:
                held.append((doc[cut[-1] :], place[cut[-1] :], win[cut[-1] :]))
            last = (h[-1], doc[-1])
        for x in out:
            if len(x[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in x], schema=kinds)


def _side_in_two(anchor: np.ndarray, doc: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Whether a row's mark of either side occurs with its anchor in another document."""
    out = np.zeros(len(anchor), bool)
    for mark in (sides >> 8, sides & 255):
        key = anchor * 256 + mark
        order = np.argsort(key)
        k, d = key[order], doc[order]
        cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        two = (np.minimum.reduceat(d, cut) != np.maximum.reduceat(d, cut)) & (k[cut] % 256 != NO_SIDE)
        out[order] |= np.repeat(two, np.diff(np.append(cut, len(k))))
    return out


def _by_text(batches: Iterator[pa.RecordBatch], done: Callable[[tuple, bytes, list, np.ndarray], None], flush: Callable[[], Iterator]) -> Iterator:
    """Call ``done`` with each text (key, bytes, the other columns of its equal rows, found (at, upto)); ``flush`` yields what is ready."""
    key, text, rows, found = None, b"", [], []

    def end() -> None:
        if rows:
            done(key, text, rows, np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64))

    for batch in batches:
        if not batch.num_rows:
            continue
        doc, crc = batch.column("doc_id").to_numpy(), batch.column("crc").to_numpy()
        at, upto = (batch.column(k).fill_null(-1).to_numpy() for k in ("at", "upto"))
        body, carries = batch.column("text"), "row" in batch.schema.names
        cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1])]))
        for lo, hi in zip(cut, np.append(cut[1:], len(doc)), strict=True):
            k = (int(doc[lo]), int(crc[lo]))
            if k != key:
                end()
                key, text, rows, found = k, b"", [], []
            texts = int((at[lo:hi] < 0).sum())
            if texts:
                text = (body[int(lo)].as_py() or "").encode("utf-8", "surrogatepass")
                rows += batch.column("row").slice(lo, texts).to_pylist() if carries else [None] * texts
            if hi - lo > texts:
                found.append(np.stack([at[lo + texts : hi], upto[lo + texts : hi]]))
        yield from flush()
    end()
    yield from flush()


def _with_text(base: DataFrame, found: DataFrame) -> DataFrame:
    """Texts and what was found for them, together and sorted; found: doc_id, crc, at, upto."""
    texts = base.select("*", F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("upto"))
    rows = texts.unionByName(found.select("doc_id", "crc", "at", "upto"), allowMissingColumns=True)
    return rows.repartition(partitions(base.sparkSession), "doc_id", "crc").sortWithinPartitions("doc_id", "crc", F.col("at").asc_nulls_first())


WIDTH = 88  # bytes of a padded segment: whole words


def cut_rows(buf: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """The bytes buf[start : start + size] as rows of ``width``, filled up with zeros; buf has ``width`` bytes to spare."""
    windows = np.lib.stride_tricks.as_strided(buf, (len(buf) - width + 1, width), (1, 1))
    out = windows[start]
    out[np.arange(width) >= size[:, None]] = 0
    return out


def row_hashes(rows: np.ndarray, also: np.ndarray) -> np.ndarray:
    """A hash of each row of bytes (whole words) and of the number ``also``."""
    out = mix(also.astype(np.uint64))
    for word in np.ascontiguousarray(rows).view(np.uint64).T:
        out = mix(out ^ word)
    return out


class Seen:
    """Segments that a task has sent, with their bytes and smallest document."""

    def __init__(self) -> None:
        self.name, self.doc, self.rows = np.zeros(SEEN, np.uint64), np.zeros(SEEN, np.int64), np.zeros((SEEN, WIDTH), np.uint8)

    def repeats(self, name: np.ndarray, doc: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whether a segment equals, byte by byte, one of a smaller document of this task. Documents come in order."""
        order = np.argsort(name, kind="stable")
        n = name[order]
        fresh = np.concatenate([[True], n[1:] != n[:-1]])
        first = order[fresh]  # of each name; the smallest document, as the sort is stable
        of = first[np.cumsum(fresh) - 1]
        out = np.zeros(len(name), bool)
        out[order] = (doc[order] > doc[of]) & (rows[order] == rows[of]).all(1)
        slot = (name[first] % np.uint64(SEEN)).astype(np.int64)
        same = (self.name[slot] == name[first]) & (self.rows[slot] == rows[first]).all(1)
        older = np.zeros(len(name), np.int64)
        old = np.zeros(len(name), bool)
        old[order], older[order] = same[np.cumsum(fresh) - 1], self.doc[slot][np.cumsum(fresh) - 1]
        at = np.flatnonzero(old & ~out)
        out[at] = (doc[at] > older[at]) & (rows[at] == self.rows[(name[at] % np.uint64(SEEN)).astype(np.int64)]).all(1)
        self.name[slot[~same]], self.doc[slot[~same]], self.rows[slot[~same]] = name[first[~same]], doc[first[~same]], rows[first[~same]]
        return out


def _segment_rows(length: int, seed: int):
    """Segments of shared anchors with their bytes; those that repeat a smaller document of the task as intervals (without bytes, s: the end).

    h only groups segments (32 bits; two anchors in one group are compared for nothing).
    """
    kinds = pa.schema([("h", pa.int32()), ("s", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("off", pa.int32()), ("segment", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[tuple[tuple, bytes, np.ndarray]] = []
        held = [0, 0]
        seen = Seen()

        def done(key: tuple, text: bytes, rows: list, found: np.ndarray) -> None:
            if found.shape[1]:
                _, at = np.unique(found[0], return_index=True)
                texts.append((key, text, found[:, at]))
                held[0] += len(text)
                held[1] += len(at)

        def flush(least: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
            if not texts or (held[0] < least and held[1] < BATCH // 4):
                return
            buf = np.frombuffer(b"".join([*(t for _, t, _ in texts), bytes(WIDTH)]), np.uint8)
            n = np.array([len(t) for _, t, _ in texts])
            base = np.cumsum(n) - n
            row = np.repeat(np.arange(len(texts)), [f.shape[1] for _, _, f in texts])
            found = np.concatenate([f for _, _, f in texts], axis=1)
            doc, crc = (np.array([k[i] for k, _, _ in texts]) for i in (0, 1))
            far = int(n.max()) + 2
            texts.clear()
            held[:] = 0, 0
            for lo in range(0, len(row), BATCH // 4):
                r, (start, win) = row[lo : lo + BATCH // 4], found[:, lo : lo + BATCH // 4]
                off, size = win >> 6, (win & 63) + length
                rows = cut_rows(buf, base[r] + start, size, WIDTH)
                seeds = cut_rows(buf, base[r] + start + off, np.full(len(r), seed), -(-seed // 8) * 8)
                h = row_hashes(seeds, np.full(len(r), seed))
                s = row_hashes(rows, size << 8 | off) ^ h
                gone = seen.repeats(s, doc[r], rows)
                some = np.flatnonzero(~gone)
                ends = np.cumsum(size[some])
                flat = rows[some][np.arange(WIDTH) < size[some, None]]
                segment = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(flat)])
                cols = [(h[some] >> np.uint64(32)).astype(np.uint32).view(np.int32), signed(s[some]), doc[r[some]], (crc[r[some]] << _POSITION) | start[some], off[some].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), segment], schema=kinds)
                if gone.any():
                    g = np.flatnonzero(gone)
                    shift = r[g] * far  # texts side by side, so that one union serves all
                    spans = union(start[g] + shift, start[g] + size[g] + shift)
                    at = spans[:, 0] // far
                    spans = spans - (at * far)[:, None]
                    place = (crc[at] << _POSITION) | spans[:, 0]
                    spread = (mix(place.view(np.uint64) ^ mix(doc[at].view(np.uint64))) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(spans[:, 1]), pa.array(doc[at]), pa.array(place), pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.binary())], schema=kinds)

        yield from _by_text(batches, done, flush)
        yield from flush(0)

    return run


class Column:
    """Numbers that are written and read from front to back: blocks in memory while they are few, then a file."""

    def __init__(self, kind: type) -> None:
        self.kind = np.dtype(kind)
        self.blocks: list[np.ndarray] = []
        self.size, self.at, self.file = 0, 0, None

    def write(self, x: np.ndarray) -> None:
        x = np.ascontiguousarray(x, self.kind)
        self.size += x.nbytes
        if self.file is None and self.size > SPOOL:
            self.file = tempfile.TemporaryFile()
            for block in self.blocks:
                self.file.write(block)
            self.blocks = []
        if self.file is not None:
            self.file.write(x)
        else:
            self.blocks.append(x)

    def rewind(self) -> None:
        self.at = 0
        if self.file is not None:
            self.file.seek(0)
        elif len(self.blocks) > 1:
            self.blocks = [np.concatenate(self.blocks)]

    def read(self, n: int) -> np.ndarray:
        if self.file is not None:
            return np.frombuffer(self.file.read(n * self.kind.itemsize), self.kind)
        self.at += n
        return self.blocks[0][self.at - n : self.at] if self.blocks else np.zeros(0, self.kind)

    def close(self) -> None:
        self.blocks = []
        if self.file is not None:
            self.file.close()


_PLACE = np.uint32((1 << 24) - 1)


def in_order(entries: np.ndarray) -> np.ndarray:
    """Fewer than 2 ** 24 entries by symbol, then place: both in one number, the symbol in its upper byte."""
    key = entries.astype(np.uint32)
    key <<= np.uint32(24)
    key |= _numbers(len(entries))
    key.sort()
    return key


_counted = [np.arange(0, dtype=np.uint32)]


def _numbers(n: int) -> np.ndarray:
    if len(_counted[0]) < n:
        _counted[0] = np.arange(2 * n, dtype=np.uint32)
    return _counted[0][:n]


def least_between(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least of x[start] .. x[end - 1] of each range; taken from the last to the first, so that nothing between ranges is looked at."""
    if not len(start):
        return np.zeros(0, np.int64)
    pairs = np.stack([start[::-1], end[::-1]], 1).reshape(-1)
    return np.minimum.reduceat(np.append(x, np.uint8(255)), pairs)[::2][::-1].astype(np.int64)


def least_upto(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The least of x[0] .. x[at] for each place of ``at``."""
    to = np.unique(at)
    cut = np.concatenate([[0], to[:-1] + 1])
    return np.minimum.accumulate(np.minimum.reduceat(x[: to[-1] + 1], cut))[np.searchsorted(to, at)]


def symbol_bounds(key: np.ndarray) -> np.ndarray:
    """Where each symbol begins among entries in order, and the end."""
    return np.append(np.searchsorted(key, np.arange(256, dtype=np.uint32) << np.uint32(24)), len(key))


class Collection:
    """The suffixes of a collection of byte strings in order, built column by column.

    An entry of ``column`` is the symbol before a suffix, plus one (0: none; UTF-8 has no byte
    255), and in the upper byte the common prefix with the suffix before.
    """

    def __init__(self, rows: np.ndarray, length: np.ndarray, block: int | None = None) -> None:
        """rows: the strings, filled up to equal width."""
        self.block, self.m, self.length = block or BLOCK, len(length), length.astype(np.int64)
        rounds = int(length.max(initial=0))
        place = self.length[:, None] - 1 - np.arange(rounds + 1)
        text = np.where(place >= 0, np.take_along_axis(rows, place.clip(0), 1) + np.uint8(1), np.uint8(0)) if rounds else np.zeros((self.m, 1), np.uint8)
        self.before = np.ascontiguousarray(text.T)  # of each round, the symbols before the suffixes
        self.column = Column(np.uint16)
        self.column.write(self.before[0])
        self.count = np.bincount(self.before[0], minlength=256)
        self.n = self.m
        strings = at = np.arange(self.m, dtype=np.int32)
        sign = self.before[0]
        for j in range(1, rounds + 1):
            strings, at, sign = self._insert(strings, at, sign, j)

    def close(self) -> None:
        self.column.close()

    def _starts(self) -> np.ndarray:
        """Where the suffixes begin that start with a symbol."""
        return self.m + np.concatenate([[0, 0], np.cumsum(self.count[1:])])[:256]

    def _insert(self, strings: np.ndarray, at: np.ndarray, sign: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Insert the suffixes of length j; each goes where its symbol's occurrence at the shorter suffix points.

        strings: in the order of their suffixes of length j - 1, which stand ``at`` and have
        ``sign`` before them. Returns all three for length j.
        """
        some = sign > 0
        if not some.all():
            strings, at, sign = strings[some], at[some], sign[some]
        place, where, value = self._ranks(at, sign)
        order = np.argsort(sign, kind="stable")
        strings, place = strings[order], place[order]
        symbol = self.before[j][strings]
        self._merge(place, symbol, where, value)
        self.count += np.bincount(symbol, minlength=256)
        self.n += len(strings)
        return strings, place, symbol

    def _ranks(self, q: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One pass over transform and common prefixes.

        q: where the growing suffixes stand, sorted; sign: the symbols before them. Returns the
        places of the longer suffixes, and (place, common prefix) of these and of the suffixes
        that follow them.
        """
        start, seen = self._starts(), np.zeros(256, np.int64)
        since, last_new = np.full(256, 255), np.zeros(256, bool)  # of each symbol's last occurrence: the least common prefix since, whether it grows
        self.column.rewind()
        place = np.empty(len(q), np.int32)
        where, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, self.n, self.block):
            size = min(self.block, self.n - lo)
            entries = self.column.read(size)
            common = (entries >> 8).astype(np.uint8)
            a, b = np.searchsorted(q, (lo, lo + size))
            key = in_order(entries)
            bound = symbol_bounds(key)
            here, bound = np.diff(bound), bound[:-1]
            base = start + seen - bound
            c = sign[a:b]
            by = np.argsort(c, kind="stable")
            mine = np.searchsorted(key, ((c.astype(np.uint32) << np.uint32(24)) | (q[a:b] - lo).astype(np.uint32))[by])
            place[a + by] = base[c[by]] + mine
            sorted_c = c[by]
            behind = mine + 1  # the suffixes behind the new ones, if of the same symbol and not new themselves
            old = behind < (bound + here)[sorted_c]
            old[:-1] &= mine[1:] != behind[:-1]
            first = mine == bound[sorted_c]
            heads = np.flatnonzero((here > 0) & last_new)  # symbols whose last suffix in the blocks before is new
            own = np.zeros(size + 1, bool)
            own[mine] = True
            heads = heads[~own[bound[heads]]]
            before = (key[np.maximum(mine - 1, 0)] & _PLACE).astype(np.int64) + 1
            at = (key[mine] & _PLACE).astype(np.int64) + 1
            value_new = np.zeros(len(mine), np.int64)
            value_new[~first] = least_between(common, before[~first], at[~first]) + 1
            if lo and (first.any() or len(heads)):
                of = np.concatenate([sorted_c[first], heads])
                upto = least_upto(common, (key[np.concatenate([mine[first], bound[heads]])] & _PLACE).astype(np.int64))
                both = np.where(seen[of] > 0, np.minimum(since[of], upto).astype(np.int64) + 1, 0)
                value_new[first] = both[: first.sum()]
                where.append(base[heads] + bound[heads])
                value.append(both[first.sum() :])
            after = (key[behind[old]] & _PLACE).astype(np.int64) + 1
            where += [base[sorted_c] + mine, base[sorted_c[old]] + behind[old]]
            value += [value_new, least_between(common, at[old], after) + 1]
            if lo + size < self.n:
                present = np.flatnonzero(here)
                tail = bound[present] + here[present] - 1
                since = np.minimum(since, int(common.min()))
                left = size - 1 - (key[tail] & _PLACE).astype(np.int64)  # entries behind the last occurrence
                since[present] = np.where(left > 0, least_upto(common[::-1], np.maximum(left - 1, 0)), 255)
                last_new[present] = own[tail]
                seen += here
        return place, np.concatenate(where), np.concatenate(value)

    def _merge(self, place: np.ndarray, symbol: np.ndarray, where: np.ndarray, value: np.ndarray) -> None:
        """One pass that writes the column anew with the new suffixes at ``place`` (sorted)."""
        old, self.column = self.column, Column(np.uint16)
        old.rewind()
        total = self.n + len(place)
        if total > self.block:
            order = np.argsort(where)
            where, value = where[order], value[order]
        for lo in range(0, total, self.block):
            size = min(self.block, total - lo)
            a, b = np.searchsorted(place, (lo, lo + size)) if total > self.block else (0, len(place))
            there = np.ones(size, bool)
            there[place[a:b] - lo] = False
            x = np.empty(size, np.uint16)
            x[there] = old.read(size - (b - a))
            x[place[a:b] - lo] = symbol[a:b]
            a, b = np.searchsorted(where, (lo, lo + size)) if total > self.block else (0, len(where))
            x.view(np.uint8)[1::2][where[a:b] - lo] = value[a:b]
            self.column.write(x)
        old.close()

    def owners(self) -> np.ndarray:
        """Of each suffix, in order, its string * 2 ** _OWNER + start: the transform leads from a suffix to the longer one."""
        start, seen = self._starts(), np.zeros(256, np.int64)
        longer = np.empty(self.n, np.uint32)
        self.column.rewind()
        for lo in range(0, self.n, self.block):
            size = min(self.block, self.n - lo)
            key = in_order(self.column.read(size))
            bound = symbol_bounds(key)
            here = np.diff(bound)
            longer[lo + (key & _PLACE)] = np.arange(size) + np.repeat(start + seen - bound[:-1], here)
            seen += here
        out = np.empty(self.n, np.uint32)
        strings = at = np.arange(self.m)
        for j in range(int(self.length.max(initial=0)) + 1):
            some = self.length[strings] >= j
            strings = strings[some]
            at = longer[at[some]] if j else at
            out[at] = (strings << _OWNER) + self.length[strings] - j
        return out

    def repeated(self, length: int, docs: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Substrings of ``length`` bytes that two documents have, as string * 2 ** _OWNER + start, and whether a document smaller than the string's has one.

        docs: the smallest document of each string; many: whether it has others.
        """
        self.column.rewind()
        fresh = np.concatenate([(self.column.read(min(self.block, self.n - lo)) >> 8) < length for lo in range(0, self.n, self.block)]) if self.n else np.zeros(0, bool)
        owner = self.owners()
        member = ~fresh
        member[:-1] |= ~fresh[1:]
        string = owner >> _OWNER
        member |= many[string] & (self.length[string] - (owner & ((1 << _OWNER) - 1)) >= length)
        at = np.flatnonzero(member)
        if not len(at):
            return at, np.zeros(0, bool)
        string = string[at]
        cut = np.flatnonzero(fresh[at])
        least = np.repeat(np.minimum.reduceat(docs[string], cut), np.diff(np.append(cut, len(at))))
        return owner[at].astype(np.int64), least < docs[string]


def first_owners(strings: list[bytes], docs: np.ndarray, length: int, block: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(string, start) of the substrings of ``length`` bytes that also start in a string of a smaller document."""
    size = np.array([len(s) for s in strings], np.int64)
    rows = np.frombuffer(b"".join(s.ljust(int(size.max()), bytes(1)) for s in strings), np.uint8).reshape(len(size), -1)
    collection = Collection(rows, size, block)
    try:
        found, less = collection.repeated(length, docs, np.zeros(len(strings), bool))
        return found[less] >> _OWNER, found[less] & ((1 << _OWNER) - 1)
    finally:
        collection.close()


class Segments:
    """Distinct segments as padded rows, with their sizes, the places of their anchors, smallest documents and whether they have others."""

    def __init__(self, rows: np.ndarray, size: np.ndarray, off: np.ndarray, docs: np.ndarray, many: np.ndarray, length: int, seed: int) -> None:
        self.rows, self.size, self.off, self.docs, self.many, self.length, self.seed = rows, size, off, docs, many, length, seed

    def repeated(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """string * 2 ** _OWNER + start of what two documents have, sorted, and of what a document smaller than the segment's has."""
        found, less = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for some in self.parts(ids, 0, 0):
            collection = Collection(self.rows[some], self.size[some])
            try:
                owner, lower = collection.repeated(self.length, self.docs[some], self.many[some])
            finally:
                collection.close()
            owner = (some[owner >> _OWNER] << _OWNER) | (owner & ((1 << _OWNER) - 1))
            found.append(owner)
            less.append(owner[lower])
        return np.unique(np.concatenate(found)), np.unique(np.concatenate(less))

    def parts(self, ids: np.ndarray, left: int, right: int) -> Iterator[np.ndarray]:
        """Sets of at most BATCH segments such that all with an equal string meet in one; ids agree in their anchors and the bytes ``left`` and ``right`` of them."""
        missing = self.length - self.seed - left - right
        if len(ids) <= BATCH:
            yield ids
            return
        if missing <= 0:  # one string, in so many segments: those of the two smallest documents stand for all
            order = ids[np.argsort(self.docs[ids], kind="stable")]
            for lo in range(1, len(order), BATCH - 1):
                yield np.concatenate([order[:1], order[lo : lo + BATCH - 1]])
            return
        half = -(-missing // 2)
        for more_left, more_right in ((left + half, right), (left, right + half)):
            some = ids[(self.off[ids] >= more_left) & (self.size[ids] - self.off[ids] - self.seed >= more_right)]
            yield from self.grouped(some, self.contexts(some, more_left, more_right), more_left, more_right)

    def contexts(self, ids: np.ndarray, left: int, right: int) -> np.ndarray:
        flat = np.append(self.rows[ids].reshape(-1), np.zeros(WIDTH, np.uint8))
        size = self.seed + left + right
        return row_hashes(cut_rows(flat, np.arange(len(ids)) * WIDTH + self.off[ids] - left, np.full(len(ids), size), -(-size // 8) * 8), np.full(len(ids), size))

    def grouped(self, ids: np.ndarray, key: np.ndarray, left: int, right: int) -> Iterator[np.ndarray]:
        """Whole groups of equal keys, as many as fit; a larger one by a wider context."""
        order = np.argsort(key, kind="stable")
        ids, key = ids[order], key[order]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(cut, len(key)))
        held, n = [], 0
        some = (size > 1) | self.many[ids[cut]]
        for lo, k in zip(cut[some].tolist(), size[some].tolist(), strict=True):
            if k > BATCH:
                yield from self.parts(ids[lo : lo + k], left, right)
                continue
            if n + k > BATCH:
                yield np.concatenate(held)
                held, n = [], 0
            held.append(ids[lo : lo + k])
            n += k
        if held:
            yield np.concatenate(held)


class Pile:
    """Rows of columns that are gathered and then read: in memory up to BATCH rows, then in files of this task."""

    NAMES = ("h", "s", "doc_id", "place", "off", "size")

    def __init__(self) -> None:
        self.parts: list[dict] = []
        self.n, self.files = 0, None

    def add(self, part: dict) -> None:
        self.parts.append(part)
        self.n += len(part["h"])
        if self.n > 2 * BATCH:
            self.files = self.files or {k: tempfile.TemporaryFile() for k in (*self.NAMES, "bytes")}
            for p in self.parts:
                for k, f in self.files.items():
                    f.write(np.ascontiguousarray(p[k]))
            self.parts = []

    def take(self) -> dict:
        """All columns; the pile is empty then."""
        kinds = {"h": np.int32, "off": np.int32, "size": np.int64, "bytes": np.uint8}
        if self.files is None:
            out = {k: np.concatenate([p[k] for p in self.parts]) for k in (*self.NAMES, "bytes")} if self.parts else {}
        else:
            for p in self.parts:
                for k, f in self.files.items():
                    f.write(np.ascontiguousarray(p[k]))
            for f in self.files.values():
                f.flush()
            out = {k: np.memmap(f, kinds.get(k, np.int64), "r") for k, f in self.files.items()}
        self.__init__()
        return out


def _compare_segments(length: int, seed: int):
    """Of segment rows sorted by (h, s, doc_id): the intervals to remove, as (doc_id, crc, at, upto)."""
    kinds = pa.schema([("doc_id", pa.int64()), ("crc", pa.int64()), ("at", pa.int64()), ("upto", pa.int64())])

    def batch_of(doc: np.ndarray, place: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        start = place & ((1 << _POSITION) - 1)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place >> _POSITION), pa.array(start + a), pa.array(start + b)], schema=kinds)

    def columns(batch: pa.RecordBatch) -> dict:
        body = batch.column("segment")
        bounds = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
        out = {k: batch.column(k).to_numpy() for k in ("h", "s", "doc_id", "place")}
        return out | {"off": batch.column("off").to_numpy(), "size": np.diff(bounds), "bytes": np.frombuffer(body.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]}

    def split(x: dict, at: int) -> tuple[dict, dict]:
        n = int(x["size"][:at].sum())
        return {k: v[:n] if k == "bytes" else v[:at] for k, v in x.items()}, {k: v[n:] if k == "bytes" else v[at:] for k, v in x.items()}

    def settle(x: dict) -> Iterator[pa.RecordBatch]:
        """x: all rows of some anchors."""
        h, s, doc, place, size = (x[k] for k in ("h", "s", "doc_id", "place", "size"))
        start = np.cumsum(size) - size
        fresh = np.ones(len(h), bool)
        rows, before = [], None
        for lo in range(0, len(h), BATCH):  # rows with equal bytes are one segment
            hi = min(lo + BATCH, len(h))
            buf = np.append(x["bytes"][start[lo] : start[hi - 1] + size[hi - 1]], np.zeros(WIDTH, np.uint8))
            part = cut_rows(buf, start[lo:hi] - start[lo], size[lo:hi], WIDTH)
            same = (h[lo + 1 : hi] == h[lo : hi - 1]) & (s[lo + 1 : hi] == s[lo : hi - 1]) & (size[lo + 1 : hi] == size[lo : hi - 1])
            fresh[lo + 1 : hi] = ~(same & (part[1:] == part[:-1]).all(1))
            if lo:
                fresh[lo] = not (h[lo] == h[lo - 1] and s[lo] == s[lo - 1] and size[lo] == size[lo - 1] and (part[0] == before).all())
            rows.append(part[fresh[lo:hi]])
            before = part[-1].copy()
        first = np.flatnonzero(fresh)
        docs = np.asarray(doc[first])
        many = np.maximum.reduceat(doc, first) > docs
        of = np.cumsum(fresh) - 1
        segments = Segments(np.concatenate(rows), np.asarray(size[first]), np.asarray(x["off"][first]).astype(np.int64), docs, many, length, seed)
        anchor = np.cumsum(np.concatenate([[True], h[first][1:] != h[first][:-1]])) - 1
        alone = np.bincount(anchor)[anchor] == 1
        same = np.flatnonzero((alone & many)[of] & (doc > docs[of]))  # the only segment of its anchor: all that is equal to it are its copies
        for i in range(0, len(same), BATCH):
            r = same[i : i + BATCH]
            yield batch_of(doc[r], place[r], np.zeros(len(r), np.int64), np.asarray(size[r]))
        use = np.flatnonzero(~alone)
        for lo, hi in anchor_runs(anchor[use]):
            found, less = segments.repeated(use[lo:hi])
            own = np.searchsorted(of, [use[lo], use[hi - 1] + 1])
            row = np.arange(*own)
            later = doc[row] > docs[of[row]]
            yield from intervals(found, row[later], of, doc, place)
            yield from intervals(less, row[~later], of, doc, place)

    def intervals(found: np.ndarray, row: np.ndarray, of: np.ndarray, doc: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        """What is removed of the rows: the runs of the starts that were found for their segments."""
        if not len(found) or not len(row):
            return
        cut = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1] + 1]))
        last = found[np.append(cut[1:], len(found)) - 1]
        string, begin, end = found[cut] >> _OWNER, found[cut] & ((1 << _OWNER) - 1), (last & ((1 << _OWNER) - 1)) + length
        for i in range(0, len(row), BATCH):
            r = row[i : i + BATCH]
            lo, hi = np.searchsorted(string, of[r]), np.searchsorted(string, of[r], "right")
            n = hi - lo
            at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            r = np.repeat(r, n)
            if len(r):
                yield batch_of(doc[r], place[r], begin[at], end[at])

    def anchor_runs(anchor: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of whole anchors, of at most BATCH segments if no single one has more."""
        cut = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1], [True]])) if len(anchor) else np.zeros(1, np.int64)
        i = 0
        while i < len(cut) - 1:
            j = max(i + 1, int(np.searchsorted(cut, cut[i] + BATCH, "right")) - 1)
            yield int(cut[i]), int(cut[j])
            i = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pile, last = Pile(), None
        for batch in batches:
            known = batch.column("segment").is_null()
            if known.true_count:
                gone = batch.filter(known)
                place, end = gone.column("place").to_numpy(), gone.column("s").to_numpy()
                yield batch_of(gone.column("doc_id").to_numpy(), place, np.zeros(len(end), np.int64), end - (place & ((1 << _POSITION) - 1)))
                batch = batch.filter(pc.invert(known))
            if not batch.num_rows:
                continue
            x = columns(batch)
            if pile.n >= BATCH and x["h"][-1] != last:  # the anchor that is open ends here
                part, x = split(x, int(np.searchsorted(x["h"], last, "right")))
                pile.add(part)
                yield from settle(pile.take())
            pile.add(x)
            last = x["h"][-1]
        if pile.n:
            yield from settle(pile.take())

    return run


def _apply(schema: str):
    kinds = arrow_schema(StructType.fromDDL(schema))
    as_text = "kept" in kinds.names and pa.types.is_string(kinds.field("kept").type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {k.name: [] for k in kinds}

        def done(key: tuple, text: bytes, rows: list, found: np.ndarray) -> None:
            spans = union(found[0], found[1])
            kept = text
            if len(spans):
                edges = [0, *spans.reshape(-1).tolist(), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            row = {"doc_id": key[0], "n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(spans), "kept_sha256": hashlib.sha256(kept).hexdigest()}
            row["kept"] = kept.decode("utf-8", "ignore") if as_text else kept
            for k, v in out.items():
                v += rows if k == "row" else [row[k]] * len(rows)

        def flush() -> Iterator[pa.RecordBatch]:
            if out["doc_id"]:
                yield to_batch(out, kinds)
                for v in out.values():
                    v.clear()

        yield from _by_text(batches, done, flush)

    return run


def union(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Disjoint spans (n x 2) of the union of intervals; those that touch are one."""
    if not len(start):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    cut = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return np.stack([start[cut], reach[np.append(cut[1:], len(start)) - 1]], 1)


def repeated_intervals(base: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, crc, at, upto): intervals of bytes covered by strings that also start in a smaller document. base: doc_id, text, crc."""
    if length + (length - seed) > WIDTH:
        raise ValueError(f"strings of {length} bytes around seeds of {seed} make segments of more than {WIDTH} bytes")
    n = partitions(base.sparkSession)
    rows = map_arrow(base.select("doc_id", "crc", "text"), _anchor_rows(length, seed), "h long, doc_id long, place long, win int")
    shared = rows.repartition(n, F.shiftright("h", 16)).sortWithinPartitions("h").mapInArrow(_shared_anchors, "doc_id long, place long, win int")
    shared = materialize(shared, "shared-anchors")
    found = shared.select("doc_id", F.shiftright("place", _POSITION).alias("crc"), F.col("place").bitwiseAND(F.lit((1 << _POSITION) - 1)).alias("at"), F.col("win").cast("long").alias("upto"))
    segments = _with_text(base.select("doc_id", "crc", "text"), found).mapInArrow(_segment_rows(length, seed), "h int, s long, doc_id long, place long, off int, segment binary")
    removed = segments.repartition(n, "h").sortWithinPartitions("h", "s", "doc_id").mapInArrow(_compare_segments(length, seed), "doc_id long, crc long, at long, upto long")
    removed = materialize(removed, "repeated-intervals")
    release(shared)
    return removed


def _told_apart(known: DataFrame) -> DataFrame:
    """``known`` with the checksum of the text in ``crc`` where a doc_id is repeated; zero elsewhere, which keeps the rows that are shuffled short."""
    repeated = known.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again"))
    repeated = materialize(repeated, "repeated-ids")
    if repeated.isEmpty():
        return known
    joined = known.join(repeated, F.col("doc_id") == F.col("again"), "left")
    return joined.withColumn("crc", F.when(F.col("again").isNotNull(), F.crc32(F.col("text").cast("binary"))).otherwise(F.col("crc"))).drop("again")


def dedup_substrings(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", with_rows: bool = True, as_text: bool = False) -> DataFrame:
    """Remove from each text every byte covered by a ``length``-byte string that also starts in a document with a smaller doc_id.

    Returns one row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256 and, with ``with_rows``, kept (the remaining bytes; a cut
    may fall within a character; ``as_text``: the remaining text, without characters that
    a cut splits) and row (the other columns as they were). Texts are UTF-8 bytes, null is
    empty; strings do not cross documents and are judged on the input. Rows without
    doc_id have no order: they lose nothing and nothing is removed for them. Rows that
    repeat a doc_id lose what smaller doc_ids have, nothing to each other. Texts shorter
    than ``length`` stay; an empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    others = [c for c in docs.columns if c not in (doc_id, text)]
    row = [F.struct(*others).alias("row")] if with_rows and others else []
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), F.lit(0).cast("long").alias("crc"), *row)
    known = _told_apart(base.where("doc_id is not null"))
    removed = repeated_intervals(known, length)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + f", kept {'string' if as_text else 'binary'}" * with_rows
    schema += f", row {base.schema['row'].dataType.simpleString()}" if row else ""
    out = _with_text(known, removed).mapInArrow(_apply(schema), schema)
    raw = F.col("text").cast("binary")
    zero = F.lit(0).cast("long")
    same = [F.col("doc_id"), F.octet_length(raw).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256")]
    return out.union(base.where("doc_id is null").select(*same, *[(F.col("text") if as_text else raw).alias("kept")] * with_rows, *["row"] * bool(row)))
