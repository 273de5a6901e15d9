"""Secrets in whole texts: patterns of named kinds, and strings that are random by a battery of tests.

Patterns (fixed): assignments to password-like names, access key ids, long lower-case hex.

Random strings. A candidate is a run of 16 or more of ``A-Za-z0-9+/_-``. Its characters
name its encoding (hex, base32, base36, base62, base64 ...), and three tests of that
alphabet ask whether it could be random: chi-squared for uniform symbols, runs above and
below the middle of the alphabet, and serial correlation of neighbours. One
probability is made of the three. A string that the battery rejects (below ALPHA) is no secret.

Ordinary words pass such tests too if they are short enough, so the battery is also run over
the ordinary text of all documents, glued to strings of LENGTHS characters (with and without
a hyphen for each gap). A candidate's p-value is the share of ordinary strings of its length
that have its encoding and look at least as random. Within each class of lengths the
procedure of Benjamini and Hochberg then keeps the share of ordinary strings among the
findings at RATE. Both counts are histograms of a few thousand cells, whatever the corpus.
Digits alone, and with separators, are numbers and no candidates.

A random string that overlaps a span of a named kind is not reported again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import arrow_schema, column_bytes, map_arrow, slices, small_batches, to_batch

KINDS = ("assign", "access", "hex", "random")
# fixed patterns of the named kinds; group 2 of the first must have 6 characters
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

LENGTHS = (16, 20, 24, 32, 40, 64)  # lengths of ordinary strings; a candidate belongs to the longest that it has
ALPHA, RATE = 0.005, 0.05
BINS = 48  # of -4 ln p of the battery; the last one holds all that ALPHA rejects and more

# --- encodings ---------------------------------------------------------------------------------
# What a byte is, as bits: digits 2-7, other digits, a-f, g-z, A-F, G-Z, symbols.
_LOW_DIGIT, _DIGIT, _AF, _GZ, _UAF, _UGZ, _SYMBOL = (1 << i for i in range(7))
_CLASS = np.zeros(256, np.uint8)
for _chars, _bit in (("234567", _LOW_DIGIT), ("0189", _DIGIT), ("abcdef", _AF), ("ghijklmnopqrstuvwxyz", _GZ), ("ABCDEF", _UAF), ("GHIJKLMNOPQRSTUVWXYZ", _UGZ), ("+/_-", _SYMBOL)):
    _CLASS[list(_chars.encode())] = _bit
_NUMERAL, _LOWER, _UPPER = _LOW_DIGIT | _DIGIT, _AF | _GZ, _UAF | _UGZ
_DIGITS, _SMALL, _LARGE = b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings: name, alphabet in order (both cases of a letter are one symbol where only one case occurs).
ENCODINGS = (
    ("hex", _DIGITS + _SMALL[:6]), ("hex upper", _DIGITS + _LARGE[:6]), ("base32", _LARGE + b"234567"), ("base36 upper", _DIGITS + _LARGE), ("base36", _DIGITS + _SMALL),
    ("lower", _SMALL), ("upper", _LARGE), ("letters", _LARGE + _SMALL), ("base62", _DIGITS + _LARGE + _SMALL), ("base64", _LARGE + _SMALL + _DIGITS + b"+/"),
)
SIZES = [len(a) for _, a in ENCODINGS]
_CODES = np.zeros((len(ENCODINGS), 256), np.uint8)
for _e, (_, _alphabet) in enumerate(ENCODINGS):
    _CODES[_e, list(_alphabet)] = np.arange(len(_alphabet))
_CODES[9, list(b"-_")] = 62, 63
#: Of each encoding which symbols (rows) are digits, small letters, large letters or signs (columns that it has).
_MEMBERS = [np.array([[chr(c) in kind for kind in kinds if set(kind) & set(a.decode())] for c in a], float) for _, a in ENCODINGS for kinds in [(_DIGITS.decode(), _SMALL.decode(), _LARGE.decode(), "+/")]]


def encoding(flags: int) -> int:
    """The encoding of a string with characters of these classes; -1 for none that is tested."""
    digits, lower, upper = flags & _NUMERAL, flags & _LOWER, flags & _UPPER
    if not lower and not upper:
        return -1
    if flags & _SYMBOL:
        return 9
    if lower and upper:
        return 8 if digits else 7
    if lower:
        return 5 if not digits else 4 if flags & _GZ else 0
    if not digits:
        return 6
    return 1 if not flags & _UGZ else 3 if flags & _DIGIT else 2


_ENCODING = np.array([encoding(f) for f in range(128)], np.int8)


# --- the battery ---------------------------------------------------------------------------------


def erfc(x: np.ndarray) -> np.ndarray:
    """The complementary error function for x >= 0 (rational approximation, relative error below 1.2e-7)."""
    t = 1 / (1 + 0.5 * x)
    c = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)
    out = np.full_like(t, c[0])
    for k in c[1:]:
        out = out * t + k
    return t * np.exp(out - x * x)


def upper_tail(z: np.ndarray) -> np.ndarray:
    tail = erfc(np.abs(z) / np.sqrt(2)) / 2
    return np.maximum(np.where(z > 0, tail, 1 - tail), 1e-300)


def two_sided(z: np.ndarray) -> np.ndarray:
    return np.minimum(1, 2 * upper_tail(np.abs(z)))


def either(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """One p-value of two that may depend on each other (Bonferroni)."""
    return np.minimum(1, 2 * np.minimum(p, q))


def chi_score(observed: np.ndarray, share: np.ndarray, k: int) -> np.ndarray:
    """Normal scores of Pearson's statistic of counts (rows) over cells of these shares: its exact mean and variance, also where cells are sparse, and the cube root of Wilson and Hilferty."""
    cells = len(share)
    chi = (observed * observed / share).sum(1) / k - k
    mean, var = cells - 1, 2 * (cells - 1) + ((1 / share).sum() - cells * cells - 2 * cells + 2) / k
    df = 2 * mean * mean / var
    return (np.cbrt(np.maximum(chi, 0) / mean) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df))


def battery(codes: np.ndarray, e: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """p-values of rows of symbols (n strings by their length) if all symbols of encoding ``e`` were equally likely and independent.

    Chi-squared over symbols (two-sided: too even is not random either) and over kinds of
    symbols; runs above and below the middle of the alphabet; serial correlation of neighbours.
    """
    (n, k), size = codes.shape, SIZES[e]
    counts = np.bincount((np.arange(n)[:, None] * size + codes).ravel(), minlength=n * size).reshape(n, size)
    chi = two_sided(chi_score(counts, np.full(size, 1 / size), k))
    member = _MEMBERS[e]
    if member.shape[1] > 1:
        chi = either(chi, upper_tail(chi_score(counts @ member, member.sum(0) / size, k)))
    high = codes >= size // 2
    p = 1 - (size // 2) / size
    u = p * (1 - p)
    changes = (high[:, 1:] != high[:, :-1]).sum(1)
    z_runs = (changes - (k - 1) * 2 * u) / np.sqrt((k - 1) * 2 * u * (1 - 2 * u) + 2 * (k - 2) * (u - 4 * u * u))
    x = codes - (size - 1) / 2
    z_serial = (x[:, 1:] * x[:, :-1]).sum(1) / ((size * size - 1) / 12) / np.sqrt(k - 1)
    return chi, two_sided(z_runs), two_sided(z_serial)


def combined(chi: np.ndarray, runs: np.ndarray, serial: np.ndarray) -> np.ndarray:
    """One p-value of the battery. Runs and serial correlation both look at neighbours, so one p-value is made of those two; Fisher's method joins it with chi-squared."""
    y = -np.log(chi) - np.log(either(runs, serial))
    return np.exp(-y) * (1 + y)


def bins(p: np.ndarray) -> np.ndarray:
    """0 for the most random looking."""
    return np.minimum(-4 * np.log(np.maximum(p, 1e-300)), BINS - 1).astype(np.int64)


LAST_BIN = int(bins(np.array([ALPHA]))[0])  # the least random that the battery does not reject


def graded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encoding (-1: none) and bin of strings of one length, rows of bytes."""
    kind = _ENCODING[np.bitwise_or.reduce(_CLASS[rows], axis=1)]
    at = np.zeros(len(rows), np.int64)
    for e in np.unique(kind[kind >= 0]):
        some = np.flatnonzero(kind == e)
        at[some] = bins(combined(*battery(_CODES[e][rows[some]], e)))
    return kind, at


# --- texts -----------------------------------------------------------------------------------------


def runs(inside: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of at least ``least`` marked bytes, none across the rows' offsets."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    a, b = at[:-1], at[1:]
    keep = inside[a] & (b - a >= least) if len(a) else np.zeros(0, bool)
    return a[keep], b[keep]


def ordinary(buf: np.ndarray, offsets: np.ndarray, taken: np.ndarray, hyphens: bool) -> tuple[np.ndarray, np.ndarray]:
    """The letters and digits of a slice's rows outside of candidates, with or without a hyphen for the ASCII characters between words, and the rows' offsets in them."""
    kind = _CLASS[buf]
    keep = (kind > 0) & (kind != _SYMBOL) & ~taken
    out = buf
    if hyphens:
        gap = ~keep & (buf < 128)
        first = gap.copy()
        first[1:] &= ~gap[:-1]
        out = np.where(first, np.uint8(45), buf)
        keep = keep | first
    return out[keep], np.append(0, np.cumsum(keep))[offsets]


def glued(stream: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Each row of a stream as strings of each of LENGTHS in turn, and what is left as strings of the shortest."""
    cycle, size = sum(LENGTHS), np.diff(offsets)

    def cut(start: np.ndarray, times: np.ndarray, step: int, k: int) -> np.ndarray:
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return stream[(np.repeat(start, times) + nth * step)[:, None] + np.arange(k)]

    whole, at = size // cycle, 0
    for k in LENGTHS:
        yield cut(offsets[:-1] + at, whole, cycle, k)
        at += k
    yield cut(offsets[:-1] + whole * cycle, size % cycle // LENGTHS[0], LENGTHS[0], LENGTHS[0])


def candidates(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, end, encoding, bin of the candidates in the rows of a slice that some encoding fits."""
    a, b = runs(_CLASS[buf] > 0, offsets, LENGTHS[0])
    kind, at = np.full(len(a), -1, np.int64), np.zeros(len(a), np.int64)
    for k in np.unique(b - a):
        some = np.flatnonzero(b - a == k)
        kind[some], at[some] = graded(buf[a[some][:, None] + np.arange(k)])
    return a, b, kind, at


def length_class(k: np.ndarray) -> np.ndarray:
    return np.searchsorted(LENGTHS, k, "right") - 1


def _histograms(batch: pa.RecordBatch) -> Iterator[dict]:
    data, off = column_bytes(batch.column("text"))
    cells = np.zeros((2, len(LENGTHS), len(ENCODINGS) + 1, BINS), np.int64)
    for i, j in slices(off):
        buf, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
        if not len(buf):
            continue
        a, b, kind, grade = candidates(buf, at)
        ok = kind >= 0
        np.add.at(cells[0], (length_class(b - a)[ok], kind[ok], grade[ok]), 1)
        mark = np.zeros(len(buf) + 1, np.int64)
        mark[a] += 1
        mark[b] -= 1
        taken = np.cumsum(mark)[:-1] > 0
        for hyphens in (False, True):
            for rows in glued(*ordinary(buf, at, taken, hyphens)):
                enc, grade = graded(rows)
                counts = np.bincount(enc.astype(np.int64) % (len(ENCODINGS) + 1) * BINS + grade, minlength=(len(ENCODINGS) + 1) * BINS)
                cells[1, length_class(np.array([rows.shape[1]]))[0]] += counts.reshape(-1, BINS)
    at = np.nonzero(cells)
    yield {"ordinary": at[0] == 1, "length": at[1].astype(np.int32), "encoding": at[2].astype(np.int32), "bin": at[3].astype(np.int32), "n": cells[at]}


def cuts(cells: list[tuple[bool, int, int, int, int]], rate: float = RATE) -> np.ndarray:
    """Of each length class and encoding the last bin that is a finding (-1: none), from counts (ordinary, length, encoding, bin, n).

    An encoding beyond the last is that of ordinary strings that have none; it counts for their number.
    """
    h = np.zeros((2, len(LENGTHS), len(ENCODINGS) + 1, BINS), np.int64)
    for ordinary, length, enc, at, n in cells:
        h[int(ordinary), length, enc, at] += n
    out = np.full((len(LENGTHS), len(ENCODINGS)), -1)
    for k in range(len(LENGTHS)):
        found = h[0, k, : len(ENCODINGS), : LAST_BIN + 1]
        p = (1 + np.cumsum(h[1, k, : len(ENCODINGS)], axis=1)[:, : LAST_BIN + 1]) / (1 + h[1, k].sum())
        tested = h[0, k].sum()
        order = np.argsort(p, axis=None, kind="stable")
        upto = np.cumsum(found.ravel()[order])
        ranked = p.ravel()[order]
        last = np.append(ranked[1:] > ranked[:-1], True)  # equal p-values stand or fall together
        passed = np.flatnonzero(last & (upto > 0) & (ranked * max(tested, 1) <= rate * upto))
        if len(passed):
            out[k] = (p <= ranked[passed[-1]]).sum(1) - 1
    return out


def learn(docs: DataFrame, rate: float = RATE) -> np.ndarray:
    """The cuts for a table of texts, from counts over all of them."""
    rows = map_arrow(docs.select("text"), _histograms, "ordinary boolean, length int, encoding int, bin int, n long")
    sums = rows.groupBy("ordinary", "length", "encoding", "bin").agg(F.sum("n").alias("n"))
    return cuts([tuple(r) for r in sums.collect()], rate)  # at most 2 * 6 * 11 * 48 cells


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the named kinds in bytes, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    return out + [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]


def _slice_spans(buf: np.ndarray, at: np.ndarray, limits: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Of each row of a slice its spans (start, kind, end) in code points, in order."""
    spans: list[list[tuple[int, int, int]]] = [[(at[r] + s, k, at[r] + e) for s, k, e in base_spans(buf[at[r] : at[r + 1]].tobytes())] for r in range(len(at) - 1)]
    a, b = runs((_CLASS[buf] & (_NUMERAL | _AF)) > 0, at, LEAST_HEX)
    for s, e, r in zip(a, b, np.searchsorted(at, a, "right") - 1, strict=True):
        spans[r].append((s, 2, e))
    a, b, kind, grade = candidates(buf, at)
    new = (kind >= 0) & (grade <= limits[length_class(b - a), kind])
    for s, e, r in zip(a[new], b[new], np.searchsorted(at, a[new], "right") - 1, strict=True):
        if not any(s < x[2] and x[0] < e for x in spans[r] if x[1] < 3):
            spans[r].append((s, 3, e))
    chars = np.append(0, np.cumsum((buf & 0xC0) != 0x80))
    return [sorted((int(chars[s] - chars[at[r]]), k, int(chars[e] - chars[at[r]])) for s, k, e in row) for r, row in enumerate(spans)]


def scan(docs: DataFrame, id_col: str = "doc_id", rate: float = RATE) -> DataFrame:
    """One row per row of ``docs`` (id, text): the id and ``spans``, an array of (kind, start, end) in code points, end exclusive, by start and then kind.

    Null and empty texts have no spans; texts are read whole, of any length; repeated rows
    have equal spans. Ids may be null or repeat. No rows give no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), "text")
    limits = learn(rows, rate)
    schema = StructType([rows.schema["id"], *StructType.fromDDL("spans array<struct<kind: string, start: int, end: int>>").fields])
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = column_bytes(batch.column("text"))
            spans: list[list[dict]] = []
            for i, j in slices(off):
                buf = data[off[i] : off[j]]
                found = _slice_spans(buf, off[i : j + 1] - off[i], limits) if len(buf) else [[]] * (j - i)
                spans += [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in row] for row in found]
            yield to_batch({"id": batch.column("id"), "spans": spans}, kinds)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
