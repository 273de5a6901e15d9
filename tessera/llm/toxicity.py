"""Toxicity by a subsequence string kernel, Nystrom landmarks and a support vector machine.

The kernel compares fragments (words, and runs of single characters joined) by their
common subsequences of three characters within a span of six, each occurrence weighing
DECAY ** span, so inserted or left-out characters cost weight but not the match. It is
normalised by the summed squared weights of a fragment's occurrences.

Subsequences are hashed, so a landmark is a sparse vector, the Nystrom features of a
fragment are K_zz^(-1/2) K_z(x), and a linear machine on them folds into one weight per
hashed subsequence: scoring a fragment is a sum of table look-ups.

Two machines share the kernel. The one of fragments learns from witnesses: fragments that
occur in significantly more contexts in toxic documents than in clean ones (a context is
the word before it, so a passage that was copied many times counts once). Of clean
fragments a third of the usual and those that come closest to the witnesses are learnt from
first; then all are scored in rounds, and the worst of those inside the margin are added,
until none is inside that was not learnt from.

The one of sentences learns from all distinct sentences of the labelled documents, with or
without a witness; white space is a character inside the span, so phrases of usual words
and words that are split count. Labels are given to documents, so a toxic document weighs
one in all and its sentences share that weight, in rounds by what the machine makes of
them, never without a rest. A sentence of more than 2 x HALF characters counts as windows
of that length, half over each other.

What the machines say of a document is weighed by a logistic curve that is learnt on documents
which they did not learn from (``document_features``): its worst and second worst word, what
all words beyond the margin add up to, alone and for the document's length, its worst
sentence beyond the median of the clean documents, and its length, as a long clean text has
more occasions for a chance resemblance. All but the length speak for toxicity only.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, training_rows
from .shared import column_bytes, give_back, map_arrow, mix, slices, word_hashes, words

TABLE_BITS = 18
SPAN, DECAY = 6, 0.7
LANDMARKS = 256
NEGATIVES = 4000  # clean fragments that a round adds at most
RATIO = 8.0  # of a witness's share of toxic contexts to its share of clean ones, at least
EVIDENCE = 20.0  # of Dunning's statistic, from which a fragment is a witness
INSERTED = ".*-_'"
THRESHOLD = 0.3  # probability from which a text counts as toxic
HALF = 120  # characters of half a window
SENTENCE_ROUNDS, REST = 3, 0.1
SLICE = 1 << 20
_STEPS = [(a, b, DECAY ** (b + 1)) for b in range(2, SPAN) for a in range(1, b)]
_SINGLES = re.compile(r"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D][\x20\x09]){2,}[^\x20\x09-\x0D](?![^\x20\x09-\x0D])")


FLOOR = -1.0  # margins below it say no more
FEATURES = 6


@dataclass
class Model:
    """One weight per hashed subsequence and the bias for fragments, the same for sentences, and the curve from a document's features to its probability."""

    weights: np.ndarray
    bias: float
    curve: np.ndarray  # FEATURES slopes and the offset
    sentence: np.ndarray | None = None
    sentence_bias: float = 0.0

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.curve[:-1] + self.curve[-1], -30, 30)))


def plain_model(weights: np.ndarray, bias: float, slope: float = 2.0, offset: float = 0.0) -> Model:
    """A model of fragments alone, judged by a document's worst one."""
    return Model(weights, bias, np.array([slope, *[0.0] * (FEATURES - 1), offset]))


def occurrences(fragments: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Hashed subsequences of fragments as (owner, feature, weight).

    fragments: code points with a separator (10) before, between and after the fragments;
    separators count as the characters that bound a fragment.
    """
    cut = fragments == 10
    at = np.flatnonzero(cut)
    owner = np.cumsum(cut) - 1
    until = np.append(at, len(fragments))[np.searchsorted(at, np.arange(len(fragments)), "right")]
    first = mix(fragments.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    second, third = first * np.uint64(0xA24BAED4963EE407), first * np.uint64(0x9FB21C651E98DF25)
    for a, b, weight in _STEPS:
        i = np.flatnonzero(np.arange(len(fragments)) + b <= until)
        i = i[i + b < len(fragments)]
        feature = ((first[i] + second[i + a] + third[i + b]) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        yield owner[i], feature, weight


def joined(fragments: list[str]) -> np.ndarray:
    return np.frombuffer(("\n" + "\n".join(fragments) + "\n").encode("utf-32-le", "replace"), np.uint32)


def fragment_margins(fragments: np.ndarray, n: int, model: Model) -> np.ndarray:
    total, square = np.zeros(n), np.zeros(n)
    for owner, feature, weight in occurrences(fragments):
        total += np.bincount(owner, model.weights[feature], n)[:n] * weight
        square += np.bincount(owner, minlength=n)[:n] * weight**2
    return total / np.sqrt(np.maximum(square, 1e-12)) + model.bias


@dataclass
class Landmarks:
    """The features that landmarks have (``place``: hashed subsequence to row, the last row is zero) and K_zz^(-1/2) on them."""

    place: np.ndarray
    project: np.ndarray


def landmark_features(fragments: list[str]) -> Landmarks:
    n = len(fragments)
    parts = [(o, f, np.full(len(o), w)) for o, f, w in occurrences(joined(fragments))]
    owner, feature, weight = (np.concatenate([p[i] for p in parts]) for i in range(3))
    used, column = np.unique(feature, return_inverse=True)
    z = np.zeros((n, len(used) + 1))
    np.add.at(z, (owner, column), weight)
    z /= np.sqrt(np.maximum(np.bincount(owner, weight**2, n), 1e-12))[:, None]
    values, vectors = np.linalg.eigh(z @ z.T)
    good = values > 1e-4 * values.max()
    place = np.full(1 << TABLE_BITS, len(used), np.int32)
    place[used] = np.arange(len(used))
    return Landmarks(place, (z.T @ (vectors[:, good] / np.sqrt(values[good]))).astype(np.float32))


def spelt(text: str) -> list[str]:
    """Runs of single characters, joined."""
    return [re.sub(r"[\x20\x09]", "", x) for x in _SINGLES.findall(text)]


def contexts(texts: list[str]) -> tuple[dict[str, int], int]:
    """Of each fragment in how many contexts (words before it) it occurs, so that copied passages count once; and the number of all."""
    lower = [t.lower() for t in texts]
    data, offsets = column_bytes(pa.array([t + "".join(f"\n{x}" for x in spelt(t)) for t in lower], pa.large_string()))
    starts, ends, first = words(data, offsets)
    if not len(starts):
        return {}, 0
    h = word_hashes(data, starts, ends, lower=False)
    before = np.roll(h, 1)
    before[first[:-1][first[:-1] < len(h)]] = 0
    _, pick = np.unique(mix(h ^ (before * np.uint64(5))), return_index=True)
    _, at, n = np.unique(h[pick], return_index=True, return_counts=True)
    raw = data.tobytes()
    return {raw[starts[i] : ends[i]].decode("utf-8", "replace"): int(c) for i, c in zip(pick[at], n, strict=True)}, len(pick)


def fragment_machine(rows: list[tuple[str, int]], rng: np.random.Generator) -> tuple[np.ndarray, float, list[str]] | None:
    """Weights and bias from words and runs of single characters, and fragments to take landmarks of sentences from; none without both labels."""
    (toxic, n1), (usual_, n0) = (contexts([t for t, y in rows if y == label]) for label in (1, 0))
    seen = {1: toxic, 0: Counter(usual_)}
    if not seen[1] or not seen[0]:
        return None
    evidence = {f: likelihood_ratio(c, seen[0][f], n1, n0) for f, c in seen[1].items() if c > 1 and c * n0 >= RATIO * (seen[0][f] + 0.5) * n1}
    ranked = sorted(evidence, key=lambda f: (-evidence[f], f))
    witness = [f for f in ranked if evidence[f] >= EVIDENCE] or [f for f in ranked[:20] if evidence[f] > 0] or sorted(seen[1])[:1]
    known = set(witness)
    clean = sorted(f for f in seen[0] if f not in known)
    near = np.zeros(1 << TABLE_BITS, np.float32)
    for _, feature, weight in occurrences(joined(witness[: LANDMARKS // 2])):
        np.add.at(near, feature, weight)
    close = np.argsort(-fragment_margins(joined(clean), len(clean), plain_model(near, 0.0)), kind="stable")[: 3 * NEGATIVES]
    usual = sorted(range(len(clean)), key=lambda i: (-seen[0][clean[i]], clean[i]))
    spread = [usual[i] for i in np.unique(np.geomspace(1, max(1, len(usual)), LANDMARKS // 4).astype(int) - 1)] if usual else []
    z = landmark_features(list(dict.fromkeys(witness[: LANDMARKS // 2] + [clean[i] for i in (*close[: LANDMARKS // 4], *spread)])))
    pool = np.union1d(close, usual[: 3 * NEGATIVES]).astype(int)
    against = np.union1d(pool[::3], close[:NEGATIVES])
    learnt = np.zeros(len(clean), bool)
    count = np.sqrt([seen[1][f] for f in witness])
    positive = np.concatenate([nystrom(witness, z), nystrom([_inserted(f, rng) for f in witness for _ in range(2)], z)])
    weights, bias = np.zeros(1 << TABLE_BITS, np.float32), -1.0
    x = positive
    while len(against):  # each adds the clean fragments that the machine does not keep outside its margin
        learnt[against] = True
        x = np.concatenate([x, nystrom([clean[i] for i in against], z)])
        y = np.where(np.arange(len(x)) < len(positive), 1.0, -1.0)
        w, bias = svm(x, y, np.concatenate([count, np.repeat(count, 2) / 2, np.ones(len(x) - len(positive))]))
        weights = (z.project @ w).astype(np.float32)[z.place]
        score = np.concatenate([fragment_margins(joined(clean[i : i + 20_000]), len(clean[i : i + 20_000]), plain_model(weights, bias)) for i in range(0, len(clean), 20_000)])
        against = np.flatnonzero((score > -0.8) & ~learnt)
        against = against[np.argsort(-score[against], kind="stable")[:NEGATIVES]]
    return weights, bias, [*witness[: LANDMARKS // 4], *(clean[i] for i in (*close[: LANDMARKS // 8], *spread))]


def train(rows: list[tuple[str, int]], seed: int = 5) -> Model:
    """Fit the machines and the curve to labelled documents (text, label)."""
    rng = np.random.default_rng(seed)
    if len({y for _, y in rows}) < 2:
        return plain_model(np.zeros(1 << TABLE_BITS, np.float32), -1.0)
    said = phrases(rows)[: LANDMARKS // 2]  # first, while the driver holds little
    found = fragment_machine(rows, rng)
    if found is None:
        return plain_model(np.zeros(1 << TABLE_BITS, np.float32), -1.0)
    weights, bias, known = found
    label = np.array([y for _, y in rows])
    fold = np.zeros(len(rows), int)
    for y in (0, 1):
        of = np.flatnonzero(label == y)
        fold[of] = rng.permutation(len(of)) % 2
    if min(np.bincount(label[fold == f], minlength=2).min() for f in (0, 1)) < 1:
        return plain_model(weights, bias)
    outside = np.tile(NOTHING, (len(rows), 1))
    for f in (0, 1):
        part = fragment_machine([r for r, g in zip(rows, fold, strict=True) if g == f], rng)
        if part is not None:
            outside[fold != f] = _features([r for r, g in zip(rows, fold, strict=True) if g != f], plain_model(*part[:2]))
    give_back()
    z = landmark_features(list(dict.fromkeys([*known, *said])))
    w, b, whole = sentence_machine(rows, z, fold)
    usual = float(np.median(whole[label == 0]))
    outside[:, SENTENCE] = np.maximum(whole - usual, 0)
    return Model(weights, bias, logistic(outside, label), (z.project @ w.astype(np.float32))[z.place], float(b - usual))


def _features(rows: list[tuple[str, int]], model: Model) -> np.ndarray:
    return document_features(*column_bytes(pc.utf8_lower(pa.array([t for t, _ in rows]))), model)


def phrases(rows: list[tuple[str, int]]) -> list[str]:
    """Phrases of two and three words by their evidence for toxicity, counted in contexts like fragments."""
    counts: dict[int, dict] = {0: {}, 1: {}}
    texts: dict[int, str] = {}
    for label in (1, 0):
        data, offsets = column_bytes(pc.utf8_lower(pa.array([t for t, y in rows if y == label])))
        starts, ends, first = words(data, offsets)
        h = word_hashes(data, starts, ends, lower=False)
        row = np.searchsorted(first, np.arange(len(h)), "right")
        before = np.where(np.diff(row, prepend=-1) > 0, np.uint64(0), np.roll(h, 1))
        key = h
        for n in (2, 3):
            key = mix(key[:-1] * np.uint64(3) + h[n - 1 :]) if len(key) > 1 else key[:0]
            at = np.flatnonzero(row[: len(key)] == row[n - 1 : n - 1 + len(key)])
            _, pick = np.unique(mix(key[at] ^ (before[at] * np.uint64(5))), return_index=True)
            found, where, times = np.unique(key[at[pick]], return_index=True, return_counts=True)
            if label:
                often = np.flatnonzero(times > 1)
                counts[1][n] = (found[often], times[often], len(pick))
                for k, i in zip(found[often].tolist(), at[pick[where[often]]], strict=True):
                    texts[k] = " ".join(data[starts[i] : ends[i + n - 1]].tobytes().decode("utf-8", "replace").split())
            else:
                counts[0][n] = (found, times, len(pick))
    evidence: dict[str, float] = {}
    for n in (2, 3):
        (toxic, c1, n1), (usual, c0, n0) = counts[1][n], counts[0][n]
        if not len(toxic) or not n0:
            continue
        place = np.searchsorted(usual, toxic)
        other = np.where(np.append(usual, 0)[place] == toxic, np.append(c0, 0)[place], 0)
        for i in np.flatnonzero(c1 * n0 >= RATIO * (other + 0.5) * n1):
            evidence[texts[int(toxic[i])]] = likelihood_ratio(int(c1[i]), int(other[i]), n1, n0)
    return sorted(evidence, key=lambda f: (-evidence[f], f))


@dataclass
class Windows:
    """The sentences of texts as code points with a separator (10) around each, cut into segments; a window is one or two.

    segment: where each starts; of: its sentence's separator; window, pair: the window's first
    segment and whether the next belongs to it; row: its text; norm: of its vector.
    """

    codes: np.ndarray
    at: np.ndarray
    segment: np.ndarray
    window: np.ndarray
    pair: np.ndarray
    row: np.ndarray
    norm: np.ndarray


def sentence_windows(buf: np.ndarray, off: np.ndarray) -> Windows:
    """Windows of the lower-cased texts; a sentence ends where white space follows one of .!? or a line's end."""
    codes = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    char = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[off]
    white = (codes == 32) | ((codes >= 9) & (codes <= 13))
    stop = (codes == 46) | (codes == 33) | (codes == 63) | (codes == 10) | (codes == 13)
    inner = np.ones(len(codes), bool)
    inner[char[:-1][char[:-1] < len(codes)]] = False
    again, ended = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
    again[1:], ended[1:] = white[1:] & white[:-1] & inner[1:], white[1:] & stop[:-1] & inner[1:]
    out = np.where(white, np.uint32(32), codes)
    runs = np.flatnonzero(white & ~again)
    if len(runs):
        out[runs[np.logical_or.reduceat(ended, runs)]] = 10
    char = np.concatenate([[0], np.cumsum(~again)])[char]
    out = np.insert(out[~again], char, 10)
    at = np.flatnonzero(out == 10)
    until, full = at[1:], np.flatnonzero(np.diff(at) > 1)
    count = -(-(until[full] - at[full]) // HALF)
    first = np.cumsum(count) - count
    step = np.arange(count.sum()) - np.repeat(first, count)
    sentence = np.repeat(full, count)
    segment = at[sentence] + HALF * step
    window = np.flatnonzero((step == 0) | (step < np.repeat(count, count) - 1))
    pair = np.repeat(count, count)[window] > 1
    begin, last = segment[window], until[sentence[window]]
    end = np.minimum(begin + HALF * (1 + pair), last)
    square = sum(w * w * np.maximum(np.minimum(end, last - b + 1) - begin, 0) for _, b, w in _STEPS)
    row = np.searchsorted(char + np.arange(len(char)), at[sentence[window]], "right") - 1
    return Windows(out, at, segment, window, pair, row, np.sqrt(np.maximum(square, 1e-12)))


def window_sums(w: Windows, parts: np.ndarray) -> np.ndarray:
    """Sums over windows of what their segments have."""
    out = parts[w.window]
    out[w.pair] += parts[w.window[w.pair] + 1]
    return out


def subsequences(w: Windows) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Hashed subsequences by the place where they start, those that leave their sentence, and the weight."""
    first = mix(w.codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    second, third = first * np.uint64(0xA24BAED4963EE407), first * np.uint64(0x9FB21C651E98DF25)
    n = len(w.codes)
    for a, b, weight in _STEPS:
        if n > b:
            out = (w.at[:, None] - np.arange(1, b)).ravel()
            yield ((first[: n - b] + second[a : n - b + a] + third[b:]) >> np.uint64(64 - TABLE_BITS)).astype(np.int32), out[(out >= 0) & (out < n - b)], weight


def window_margins(w: Windows, weights: np.ndarray, bias: float) -> np.ndarray:
    total = np.zeros(len(w.codes), np.float32)
    for feature, out, weight in subsequences(w):
        value = weights[feature]
        value[out] = 0
        value *= np.float32(weight)
        total[: len(value)] += value
    return window_sums(w, np.add.reduceat(total, w.segment, dtype=np.float64)) / w.norm + bias


def window_features(w: Windows, z: Landmarks) -> np.ndarray:
    """Features of windows on the landmarks."""
    none = len(z.project) - 1
    parts = np.zeros((len(w.segment), z.project.shape[1]), np.float32)
    found = []
    for feature, out, weight in subsequences(w):
        column = z.place[feature]
        column[out] = none
        start = np.flatnonzero(column < none)
        found.append((start, column[start], weight))
    bound = np.append(w.segment, len(w.codes))
    for i in range(0, len(w.segment), 256):
        j = min(i + 256, len(w.segment))
        flat, value = [], []
        for start, column, weight in found:
            a, b = np.searchsorted(start, (bound[i], bound[j]))
            flat.append((np.searchsorted(w.segment, start[a:b], "right") - 1 - i) * none + column[a:b])
            value.append(np.full(b - a, weight))
        dense = np.bincount(np.concatenate(flat), np.concatenate(value), (j - i) * none).reshape(j - i, none)
        parts[i:j] = dense.astype(np.float32) @ z.project[:none]
    return (window_sums(w, parts) / w.norm[:, None]).astype(np.float32)


def sentence_machine(rows: list[tuple[str, int]], z: Landmarks, fold: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights on the landmarks' features and bias from all distinct sentences of the rows, and margins of the rows of either fold by the other."""
    data, offsets = column_bytes(pc.utf8_lower(pa.array([t for t, _ in rows])))
    parts = [(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets)]
    seen: set[bytes] = set()
    x = np.empty((sum(len(sentence_windows(buf, off).window) for _, buf, off in parts), z.project.shape[1]), np.float16)  # half as much for the driver to hold
    docs, n = [], 0
    for i, buf, off in parts:
        w = sentence_windows(buf, off)
        if not len(w.window):
            continue
        begin = w.segment[w.window]
        end = np.minimum(begin + HALF * (1 + w.pair), w.at[np.minimum(np.searchsorted(w.at, begin, "right"), len(w.at) - 1)])
        new = []
        for k, (a, b, r) in enumerate(zip(begin, end, w.row, strict=True)):
            key = hashlib.blake2b(w.codes[a:b].tobytes() + bytes([rows[i + r][1]]), digest_size=8).digest()
            if key not in seen:
                seen.add(key)
                new.append(k)
        x[n : n + len(new)] = window_features(w, z)[new]
        n += len(new)
        docs.append(i + w.row[new])
    x, doc = x[:n], np.concatenate(docs) if docs else np.zeros(0, np.int64)
    label = np.array([y for _, y in rows])
    y = np.where(label[doc] == 1, 1.0, -1.0)

    def dot(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.concatenate([x[i : i + 8192] @ w for i in range(0, len(x), 8192)])

    def fit(rows_of: np.ndarray | slice) -> tuple[np.ndarray, float]:
        xf, yf, d = x[rows_of], y[rows_of], doc[rows_of]
        start = np.flatnonzero(np.diff(d, prepend=-1) > 0)
        size = np.diff(np.append(start, len(d)))
        part, w, b = 1 / np.repeat(size, size), None, 0.0
        for _ in range(SENTENCE_ROUNDS):
            w, b = svm(xf, yf, np.where(yf > 0, part, 1.0), begin=None if w is None else np.append(w, b))
            m = dot(xf, w)
            m = np.exp(4 * (m - np.repeat(np.maximum.reduceat(m, start), size)))
            part = (1 - REST) * m / np.repeat(np.add.reduceat(m, start), size) + REST / np.repeat(size, size)
        return w, b

    outside = np.full(len(rows), -np.inf)
    for f in (0, 1):
        learnt, judged = np.flatnonzero(fold[doc] == f), np.flatnonzero(fold[doc] != f)
        if len(np.unique(y[learnt])) == 2:
            w, b = fit(learnt)
            np.maximum.at(outside, doc[judged], dot(x[judged], w) + b)
    outside[np.isinf(outside)] = outside[np.isfinite(outside)].min(initial=0.0)  # nothing of its own
    return *(fit(slice(None)) if len(np.unique(y)) == 2 else (np.zeros(x.shape[1]), 0.0)), outside


def likelihood_ratio(a: int, b: int, n1: int, n0: int) -> float:
    """Dunning's statistic of a fragment in a of n1 toxic and b of n0 clean contexts; negative if it speaks for clean."""

    def part(k: float, n: float, p: float) -> float:
        return (k * np.log(p) if k else 0.0) + ((n - k) * np.log(1 - p) if n > k else 0.0)

    p = (a + b) / (n1 + n0)
    value = 2 * (part(a, n1, a / n1) + part(b, n0, b / n0) - part(a, n1, p) - part(b, n0, p)) if 0 < p < 1 else 0.0
    return value if a * n0 > b * n1 else -value


def _inserted(fragment: str, rng: np.random.Generator) -> str:
    """The fragment with a foreign character between some of its characters."""
    sign = INSERTED[rng.integers(len(INSERTED))]
    where = rng.random(len(fragment)) < rng.choice([0.3, 1.0])
    return "".join(c + sign * bool(w and i + 1 < len(fragment)) for i, (c, w) in enumerate(zip(fragment, where, strict=True)))


def nystrom(fragments: list[str], z: Landmarks) -> np.ndarray:
    """Features of fragments on the landmarks."""
    n, none = len(fragments), len(z.project) - 1
    out, square = np.zeros((n, z.project.shape[1]), np.float32), np.zeros(n)
    for i in range(0, n, 20_000):
        part = fragments[i : i + 20_000]
        for owner, feature, weight in occurrences(joined(part)):
            square[i : i + len(part)] += np.bincount(owner, minlength=len(part))[: len(part)] * weight**2
            row = z.place[feature]
            owner, row = owner[row < none], row[row < none]
            cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            if len(owner):
                out[i + owner[cuts]] += np.add.reduceat(z.project[row], cuts, axis=0) * np.float32(weight)
    return out / np.sqrt(np.maximum(square, 1e-12))[:, None].astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, share: np.ndarray, c: float = 10.0, steps: int = 15, begin: np.ndarray | None = None, near: float = 1e-3) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps on the rows inside the margin until none moves a weight by ``near``; classes weigh alike."""
    cost = c * share * np.where(y > 0, 0.5 / share[y > 0].sum(), 0.5 / share[y < 0].sum()) * 100
    w = np.zeros(x.shape[1] + 1) if begin is None else begin
    ridge = np.eye(len(w)) * 1e-1
    ridge[-1, -1] = 1e-4
    for _ in range(steps):
        left, right = ridge.copy(), np.zeros(len(w))
        for i in range(0, len(x), 8192):
            a = np.ones((len(x[i : i + 8192]), len(w)), np.float32)  # products in single precision, their sums in double
            a[:, :-1] = x[i : i + 8192]
            inside = y[i : i + 8192] * (a @ w.astype(np.float32)) < 1
            a = a[inside]
            b = a * cost[i : i + 8192][inside, None].astype(np.float32)
            left += b.T @ a
            right += b.T @ y[i : i + 8192][inside].astype(np.float32)
        new = np.linalg.solve(left, right)
        done = np.abs(new - w).max() < near
        w = new
        if done:
            break
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, label: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Slopes and offset of the logistic curve through features, with Platt's smoothed targets; features but the length that would speak against toxicity are left out."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    use = x.std(0) > 1e-6
    while True:
        a = np.concatenate([((x - mean) / spread)[:, use], np.ones((len(x), 1))], axis=1)
        w = np.zeros(a.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (target - p) - ridge * w)
            w = w + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        slope = np.zeros(x.shape[1])
        slope[use] = w[:-1]
        wrong = (slope < 0) & (np.arange(len(slope)) != LENGTH_OF)
        if not wrong.any():
            slope = slope / spread
            return np.append(slope, w[-1] - slope @ mean)
        use &= ~wrong


def _gather(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points of the given words with a separator around each."""
    size = ends - starts + 1
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.full(at[-1] + 1, 10, np.uint8)
    pick = np.arange(at[-1]) - np.repeat(at[:-1], size)
    inner = pick > 0
    out[:-1][inner] = buf[(np.repeat(starts, size) + pick - 1)[inner]]
    return np.frombuffer(out.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


_LETTER = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def _word_margins(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: Model) -> np.ndarray:
    """Margins of words; of one with signs among its letters the larger of its own and of its letters'."""
    out = fragment_margins(_gather(buf, starts, ends), len(starts), model)
    size = ends - starts
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
    letter = _LETTER[buf[at]]
    count = np.add.reduceat(letter.astype(np.int64), np.cumsum(size) - size)
    mixed = np.flatnonzero((count > 1) & (count < size))
    if len(mixed):
        kept = np.isin(np.repeat(np.arange(len(size)), size), mixed) & letter
        plain, n = buf[at[kept]], count[mixed]
        bound = np.cumsum(n)
        out[mixed] = np.maximum(out[mixed], fragment_margins(_gather(plain, bound - n, bound), len(mixed), model))
    return out


class Known:
    """Margins of the words that a worker has met, by hash; starts anew beyond LIMIT words."""

    LIMIT = 400_000

    def __init__(self) -> None:
        self.hashes, self.values = np.zeros(0, np.uint64), np.zeros(0)

    def look_up(self, hashes: np.ndarray, compute) -> np.ndarray:
        """hashes: sorted; compute: margins of the words at given places."""
        at = np.searchsorted(self.hashes, hashes)
        hit = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        hit[inside] = self.hashes[at[inside]] == hashes[inside]
        out = np.empty(len(hashes))
        out[hit] = self.values[at[hit]]
        miss = np.flatnonzero(~hit)
        if len(miss):
            out[miss] = compute(miss)
            if len(self.hashes) + len(miss) > self.LIMIT:
                self.hashes, self.values = hashes, out
            else:
                self.hashes, self.values = np.insert(self.hashes, at[miss], hashes[miss]), np.insert(self.values, at[miss], out[miss])
        return out


WORST, SECOND, SUM, LENGTH_OF, RATE, SENTENCE = range(FEATURES)
NOTHING = np.array([FLOOR, FLOOR, 0.0, 0.0, 0.0, 0.0])  # of a text without words


def document_features(data: np.ndarray, offsets: np.ndarray, model: Model, known: Known | None = None) -> np.ndarray:
    """What the curve judges lower-cased texts by. Every distinct word of a slice is scored once, words in ``known`` not again."""
    known = known or Known()
    out = np.tile(NOTHING, (len(offsets) - 1, 1))
    for i, j in slices(offsets, SLICE):
        buf, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = words(buf, off)
        if not len(starts):
            continue
        hashes, pick, back = np.unique(word_hashes(buf, starts, ends, lower=False), return_index=True, return_inverse=True)
        score = known.look_up(hashes, lambda at: _word_margins(buf, starts[pick[at]], ends[pick[at]], model))
        doc = np.searchsorted(first, np.arange(len(starts)), "right") - 1
        at = np.flatnonzero(score[back] > FLOOR)
        pair = np.unique(doc[at] * len(hashes) + back[at])
        said, margin = pair // len(hashes), score[pair % len(hashes)]
        points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        single = (points[ends] - points[starts] == 1).astype(np.int8)
        runs = np.flatnonzero(single[:-2] & single[1:-1] & single[2:]) if len(single) > 2 else np.zeros(0, np.int64)
        for d in np.unique(doc[runs]):  # spelt with spaces
            found = list(dict.fromkeys(spelt(buf[off[d] : off[d + 1]].tobytes().decode("utf-8", "replace"))))
            if found:
                said = np.append(said, np.full(len(found), d))
                margin = np.append(margin, fragment_margins(joined(found), len(found), model).clip(FLOOR))
        n = np.bincount(doc, minlength=j - i)
        has = n > 0
        part = np.tile(NOTHING, (j - i, 1))
        order = np.lexsort((-margin, said))
        said, margin = said[order], margin[order]
        lead = np.flatnonzero(np.diff(said, prepend=-1) > 0)
        part[said[lead], WORST] = margin[lead]
        second = np.flatnonzero(said[1:] == said[:-1]) + 1
        second = second[np.isin(second - 1, lead)]
        part[said[second], SECOND] = margin[second]
        part[:, SUM] = np.log1p(np.bincount(said, np.maximum(margin, 0), j - i))
        part[has, LENGTH_OF] = np.log(n[has])
        part[has, RATE] = (np.bincount(doc, np.maximum(score, 0)[back], j - i)[has]) / np.sqrt(n[has])
        out[i:j] = part
    if model.sentence is not None:
        whole = np.zeros(len(out))
        for i, j in slices(offsets, SLICE >> 4):
            w = sentence_windows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if len(w.window):
                np.maximum.at(whole, i + w.row, window_margins(w, model.sentence, model.sentence_bias))
        out[:, SENTENCE] = whole
    return out


def score_texts(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``docs`` with the probability ``score`` that each whole text is toxic; ``keep``: the columns to carry along."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}

    known: list[Known] = []

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        known[:] = known or [Known()]
        data, offsets = column_bytes(pc.utf8_lower(batch.column("text")))
        score = shared.value.probability(document_features(data, offsets, shared.value, known[0]))
        yield {k: batch.column(k) for k in keep} | {"score": score}

    schema = ", ".join(f"`{k}` {fields[k]}" for k in keep)
    return map_arrow(docs.select("text", *[k for k in keep if k != "text"]), run, f"{schema}, score double")


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from at most 2 x SAMPLE_ROWS labelled documents; labels of the held-out fold are not used."""
    rows = training_rows(docs, labels, "toxic").collect()
    model = train(sorted((r["text"] or "", int(r["label"])) for r in rows))
    del rows
    give_back()
    return model


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Score all documents: doc_id, held_out, score in 0..1, predicted (score >= threshold).

    Only the text is an input of a score. Null and empty texts have no fragment and the
    features NOTHING, a low score. Without labels of both kinds every text gets the same
    score below the threshold. Repeated rows score alike; an empty table gives no rows.
    """
    model = learn(docs, labels)
    scored = score_texts(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
