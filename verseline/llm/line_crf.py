"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad.  A line's score comes from its own surface
features and those of its neighbours; a transition matrix ties neighbouring
labels, so a single odd line goes with those around it and a run of them does
not.  Forward-backward marginals, weighted by line length, give a document's
share of good text, and a one-variable logistic fit turns it into the
probability of the good label.

Features and inference are vectorised over all lines of a slice of documents;
the recursion runs over line numbers with all documents of the slice side by
side.  Fitting uses a bounded sample of labelled documents, of which only the
features reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseline.llm.text_scan import NOT_SPACE, Words, byte_class, slices, strings
from verseline.llm.tables import bound_batches, lean

#: labelled documents that a fit uses at most
SAMPLE = 4000

_UPPER = byte_class(bytes(range(65, 91)))
_LETTER = byte_class(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_DIGIT = byte_class(b"0123456789")
_STOP = byte_class(b".,;:?'\"()-")
_SPACE = byte_class(b" \t\r\x0b\x0c\n")
_BANG = byte_class(b"!")
_ODD = ~(_LETTER | _DIGIT | _STOP | _SPACE | _BANG)
#: features of a line: ratios, and whether they pass some level
LEVELS = {"odd": (0.02, 0.1), "upper": (0.12, 0.5), "digit": (0.1, 0.4), "bang": (0.02, 0.1), "again": (0.05, 0.3), "few_kinds": (0.35, 0.7), "no_stop": (0.5,), "copied": (0.5,), "long_word": (0.5,)}
NAMES = [n for name, levels in LEVELS.items() for n in (name, *(f"{name}>{x}" for x in levels))] + ["short", "log_words"]
WIDTH = len(NAMES)


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[ends] - total[starts]


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes, starts in the text, line numbers, first line of each text) of all lines with a word, texts end to end."""
    first = int(offsets[0])
    buf = data[first : int(offsets[-1])]
    offs = offsets - first
    n = len(buf)
    cut = np.flatnonzero(buf == 10)
    starts = np.union1d(offs[:-1], cut + 1)
    starts = starts[starts < n] if n else starts[:0]
    ends = np.append(starts[1:], n) if len(starts) else starts
    owner = np.searchsorted(offs, starts, "right") - 1
    number = np.arange(len(starts)) - np.searchsorted(owner, owner)
    words = Words(buf, np.append(starts, n), NOT_SPACE) if n else None
    counts = words.counts() if n else np.zeros(0, np.int64)
    some = counts > 0
    size = np.maximum(1, ends - starts).astype(float)
    many = np.maximum(1, counts).astype(float)
    odd, upper, digit, bang, letter = (_sums(c[buf], starts, ends) for c in (_ODD, _UPPER, _DIGIT, _BANG, _LETTER)) if n else [np.zeros(0)] * 5
    if n:
        line = np.repeat(np.arange(len(starts)), counts)
        h = words.hashes
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
        again = np.bincount(line[same], minlength=len(starts))
        order = np.lexsort((h, line))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
        kinds = np.bincount(line[order][new], minlength=len(starts))
        longest = np.zeros(len(starts), np.int64)
        np.maximum.at(longest, line, words.ends - words.starts)
        whole = np.zeros(len(starts), np.uint64)
        np.add.at(whole, line, h * np.uint64(0x9E3779B97F4A7C15) + h)
        order = np.lexsort((whole, owner))
        twin = np.zeros(len(starts), bool)
        hit = (whole[order][1:] == whole[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        twin[order[1:][hit]] = True
        last = buf[np.maximum(0, np.minimum(n - 1, ends - 2))]
        tail = buf[ends - 1]
        final = np.where((tail == 10) & (ends - starts > 1), last, tail)
        # kinds fall short of the words: repetition inside a line, counted from 20 words on
        few = np.clip((many - kinds) / many * np.minimum(1, many / 20), 0, 1)
    else:
        again = few = twin = final = longest = np.zeros(0)
    ratio = {
        "odd": odd / size,
        "upper": upper / np.maximum(1, letter),
        "digit": digit / size,
        "bang": bang / size,
        "again": again / many,
        "few_kinds": few,
        "no_stop": ~np.isin(final, (46, 63, 33, 58, 34)) * 1.0,
        "copied": twin * 1.0,
        "long_word": np.clip(longest / 60, 0, 1),
    }
    columns = [c for name, levels in LEVELS.items() for c in (ratio[name] * 1.0, *((ratio[name] > x) * 1.0 for x in levels))]
    out = np.column_stack([*columns, (counts < 4) * 1.0, np.log1p(counts) / 5]).astype(np.float32) if n else np.zeros((0, WIDTH), np.float32)
    out, owner = out[some], owner[some]
    return out, (ends - starts)[some], (starts - offs[np.searchsorted(offs, starts, "right") - 1])[some], number[some], np.searchsorted(owner, np.arange(len(offs)))


def beside(features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features and a constant; outside a text they are 0."""
    n, width = features.shape
    out = np.zeros((n, 3 * width + 1), np.float32)
    out[:, :width] = features
    out[1:, width : 2 * width] = features[:-1]
    out[:-1, 2 * width : -1] = features[1:]
    starts, ends = bounds[:-1], bounds[1:]
    some = ends > starts
    out[starts[some], width : 2 * width] = 0
    out[ends[some] - 1, 2 * width : -1] = 0
    out[:, -1] = 1
    return out


def forward_backward(score: np.ndarray, bounds: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P(good) of each line, log-partition of each text, expected moves (2, 2)).

    score: a line's score for good, 0 for bad.  move[a, b]: score of label b after a.
    """
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = bounds[:-1][order], sizes[order]
    n, steps = len(score), int(sizes.max(initial=0))
    emit = np.stack((np.zeros(n), score.astype(float)), axis=1)
    ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
    active = [int(np.searchsorted(-sizes, -t, "left")) for t in range(steps + 1)]  # texts with more than t lines
    partition = np.zeros(len(sizes))
    for t in range(steps):
        at = starts[: active[t]] + t
        if t == 0:
            ahead[at] = emit[at]
        else:
            before = ahead[at - 1]
            ahead[at] = emit[at] + np.logaddexp(before[:, :1] + move[0], before[:, 1:] + move[1])
    for t in range(steps - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        after = emit[at + 1] + behind[at + 1]
        behind[at] = np.logaddexp(after[:, :1] + move[:, 0], after[:, 1:] + move[:, 1])
    some = sizes > 0
    ends = starts[some] + sizes[some] - 1
    partition[np.flatnonzero(some)] = np.logaddexp(ahead[ends, 0], ahead[ends, 1])
    z = np.zeros(len(sizes))
    z[order] = partition
    each = np.repeat(z, np.diff(bounds))
    good = np.exp(ahead[:, 1] + behind[:, 1] - each) if n else np.zeros(0)
    moves = np.zeros((2, 2))
    inner = np.ones(n, bool)
    inner[bounds[:-1][np.diff(bounds) > 0]] = False
    b = np.flatnonzero(inner)
    for x in (0, 1):
        for y in (0, 1):
            moves[x, y] = np.exp(ahead[b - 1, x] + move[x, y] + emit[b, y] + behind[b, y] - each[b]).sum() if len(b) else 0
    return good, z, moves


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    move: np.ndarray
    slope: float
    shift: float

    def lines(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return forward_backward(beside(features, bounds) @ self.weights, bounds, self.move)[0]

    def scores(self, features: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        share = good_share(self.lines(features, bounds), size, bounds)
        return 1 / (1 + np.exp(-(self.slope * share + self.shift)))


def good_share(good: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Length-weighted mean of P(good), as log-odds; a text without lines has all bad."""
    total, whole = np.zeros(len(good) + 1), np.zeros(len(good) + 1)
    np.cumsum(good * size, out=total[1:])
    np.cumsum(size, out=whole[1:])
    weight = whole[bounds[1:]] - whole[bounds[:-1]]
    share = np.where(weight > 0, (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(1, weight), 0)
    share = np.clip(share, 0.001, 0.999)
    return np.log(share / (1 - share))


def fit(features: np.ndarray, size: np.ndarray, bounds: np.ndarray, label: np.ndarray, rounds: int = 150, decay: float = 1e-4) -> Model:
    """Weights by full-batch Adam on the CRF likelihood; the lines of a document carry its label.

    Classes are weighted equally; the logistic fit on top restores the base rate.
    """
    width = 3 * features.shape[1] + 1
    if not len(features) or label.min(initial=1) == label.max(initial=0):
        rate = (label.sum() + 1) / (len(label) + 2)
        return Model(np.zeros(width, np.float32), np.zeros((2, 2)), 0.0, float(np.log(rate / (1 - rate))))
    x = beside(features, bounds).astype(np.float64)
    counts = np.diff(bounds)
    y = np.repeat(label, counts).astype(float)
    weight = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum())) / np.maximum(1, counts)
    # documents of one class share a weight per line, so that moves can be summed by class
    weight = {c: 0.5 / max(1, counts[label == c].sum()) for c in (0, 1)}
    per_line = np.where(y == 1, weight[1], weight[0])
    part = {c: np.flatnonzero(label == c) for c in (0, 1)}
    w, move = np.zeros(width), np.zeros((2, 2))
    state = [np.zeros(width), np.zeros(width), np.zeros((2, 2)), np.zeros((2, 2))]
    lines_of = {c: np.flatnonzero(y == c) for c in (0, 1)}
    bounds_of = {c: np.concatenate(([0], np.cumsum(counts[part[c]]))) for c in (0, 1)}
    for step in range(1, rounds + 1):
        score = x @ w
        good, slope_move = np.empty(len(y)), np.zeros((2, 2))
        for c in (0, 1):
            good[lines_of[c]], _, moves = forward_backward(score[lines_of[c]], bounds_of[c], move)
            seen = np.zeros((2, 2))
            seen[c, c] = max(0, len(lines_of[c]) - (counts[part[c]] > 0).sum())
            slope_move += weight[c] * (seen - moves)
        grads = (x.T @ (per_line * (y - good)) - decay * w, slope_move - decay * move)
        for i, (value, grad) in enumerate(zip((w, move), grads)):
            one, two = state[2 * i], state[2 * i + 1]
            one += 0.1 * (grad - one)
            two += 0.01 * (grad * grad - two)
            value += 0.1 * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-8)
    model = Model(w.astype(np.float32), move, 1.0, 0.0)
    share = good_share(model.lines(features, bounds), size, bounds)
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-(slope * share + shift)))
        r, q = label - p, np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(q * share * share).sum() + 1, (q * share).sum()], [(q * share).sum(), q.sum() + 1e-3]])
        change = np.linalg.solve(hess, np.array([(r * share).sum() - (slope - 0.5), r.sum()]))
        slope, shift = slope + change[0], shift + change[1]
        if np.abs(change).max() < 1e-9:
            break
    return Model(w.astype(np.float32), move, float(slope), float(shift))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled documents, those whose id hashes lowest; null labels and ids are left out.

    With no labels, or one class, the model gives every text the class rate.
    """
    bound_batches(docs.sparkSession)
    picked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for lo, hi in slices(offsets):
                features, size, _, _, bounds = line_features(data, offsets[lo : hi + 1])
                edges = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([features[a:b].tobytes() for a, b in edges], pa.binary()), pa.array([size[a:b].astype(np.int64).tobytes() for a, b in edges], pa.binary())],
                    names=["doc_id", "label", "features", "size"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "doc_id")  # at most ``sample`` rows
    rows = base.select("doc_id", "text", "label").mapInArrow(lean(run), f"doc_id {kind}, label int, features binary, size binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.label, bytes(r.features)))
    features = [np.frombuffer(r.features, np.float32).reshape(-1, WIDTH) for r in rows]
    size = [np.frombuffer(r.size, np.int64) for r in rows]
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in size]))).astype(np.int64)
    return fit(np.concatenate(features or [np.zeros((0, WIDTH), np.float32)]), np.concatenate(size or [np.zeros(0, np.int64)]), bounds, np.array([r.label for r in rows], np.int64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, score (0 to 1) and n_lines; null and empty texts have no line and score as all bad."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for lo, hi in slices(offsets):
                features, size, _, _, bounds = line_features(data, offsets[lo : hi + 1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(shared.value.scores(features, size, bounds)), pa.array(np.diff(bounds).astype(np.int64))], names=["doc_id", "score", "n_lines"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"doc_id {kind}, score double, n_lines long")


def keep_good(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text scores ``threshold`` or more; columns as they were."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(at))
            for lo, hi in slices(offsets):
                features, size, _, _, bounds = line_features(data, offsets[lo : hi + 1])
                yield batch.slice(lo, hi - lo).filter(pa.array(shared.value.scores(features, size, bounds) >= threshold))

    return docs.mapInArrow(lean(run), docs.schema)


def label_lines(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per line with a word: doc_id, line (from 0), start (bytes), p_good, good."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for lo, hi in slices(offsets):
                features, _, starts, number, bounds = line_features(data, offsets[lo : hi + 1])
                ids = batch.column(0).take(pa.array(lo + np.repeat(np.arange(hi - lo), np.diff(bounds))))
                good = shared.value.lines(features, bounds)
                yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int64)), pa.array(starts.astype(np.int64)), pa.array(good), pa.array(good >= 0.5)], names=["doc_id", "line", "start", "p_good", "good"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"doc_id {kind}, line long, start long, p_good double, good boolean")


def held_out(id_col: str = "doc_id"):
    """Ids whose CRC-32, as text, is a multiple of 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
