"""Operator 8: document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features and those of its neighbours; the marginals of the
forward-backward recursion, weighted by the lines' lengths, make a document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.llm.common import CHUNK, hash_words, labelled_sample, map_batches, scan_words, slices, table, text_bytes

SAMPLE_ROWS = 6_000  # labelled rows that the model is trained on
STRETCHES, STRETCH = 4, 25  # of a sampled text with more lines than these stretches hold, as many, evenly spaced, are learned from
THRESHOLD = 0.3
_KINDS = np.zeros((6, 256), dtype=bool)  # upper, letter, digit, sentence mark, exclamation, other symbol
_KINDS[0, 65:91] = True
_KINDS[1, 65:91] = _KINDS[1, 97:123] = _KINDS[1, 0x80:] = True
_KINDS[2, 48:58] = True
_KINDS[3, [ord(c) for c in ".,;:?'\"-()"]] = True
_KINDS[4, ord("!")] = True
_KINDS[5, 33:127] = ~(_KINDS[:5].any(axis=0)[33:127])
OWN = 14
WIDTH = 3 * OWN + 1


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, sizes, bounds): one row of OWN for each line of all texts, the lines' bytes, n + 1 line offsets.

    A text has one line more than line feeds; an empty text is one empty line. Features are shares and logarithms
    of counts in the line.
    """
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    text_of_break = np.searchsorted(offsets, breaks, side="right") - 1
    per_text = 1 + np.bincount(text_of_break, minlength=n)
    bounds = np.concatenate([[0], np.cumsum(per_text)])
    # Starts of empty texts coincide with others: a text's own start comes first, then those after its line feeds.
    starts = np.empty(int(bounds[-1]), np.int64)
    starts[bounds[:-1]] = offsets[:-1]
    starts[np.arange(len(breaks)) + text_of_break + 1] = breaks + 1
    stops = np.empty_like(starts)
    stops[:-1] = starts[1:] - 1
    stops[bounds[1:] - 1] = offsets[1:]
    size = np.maximum(stops - starts, 0)

    def before(kind: np.ndarray) -> np.ndarray:
        """How many bytes of a kind stand before each place."""
        out = np.zeros(len(data) + 1, dtype=np.int32)
        np.cumsum(kind[data], dtype=np.int32, out=out[1:])
        return out

    f = np.zeros((len(starts), OWN), dtype=np.float32)
    some = np.maximum(size, 1)
    for k in range(6):
        total = before(_KINDS[k])
        f[:, k] = (total[stops] - total[starts]) / some
    w_starts, w_ends, _ = scan_words(data, offsets)
    words = np.searchsorted(w_starts, np.maximum(stops, starts)) - np.searchsorted(w_starts, starts)
    if len(w_starts):
        h = hash_words(data, w_starts)
        line = np.repeat(np.arange(len(starts)), words)
        order = np.lexsort((h, line))
        first = np.ones(len(h), dtype=bool)
        first[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
        distinct = np.bincount(line[order][first], minlength=len(starts))
        twin = np.zeros(len(h), dtype=bool)
        twin[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
        total = before(_KINDS[1])
        alone = total[w_ends] == total[w_starts]  # words without a letter
        total = before(_KINDS[0])
        shout = (total[w_ends] - total[w_starts]) * 2 > w_ends - w_starts
        some_words = np.maximum(words, 1)
        f[:, 6] = distinct / some_words
        f[:, 7] = np.bincount(line[twin], minlength=len(starts)) / some_words
        f[:, 8] = np.bincount(line[alone], minlength=len(starts)) / some_words
        f[:, 9] = np.bincount(line[shout], minlength=len(starts)) / some_words
        f[:, 10] = np.minimum(np.bincount(line, weights=w_ends - w_starts, minlength=len(starts)) / some_words / 10, 5)
    f[:, 11] = np.log1p(words) / 5
    f[:, 12] = words == 0
    f[:, 13] = np.where(size > 0, data[np.maximum(stops - 1, 0)] == ord("."), False) if len(data) else 0
    return f, size, bounds


def with_neighbours(f: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """WIDTH features of each line: its own, those of the line before and after in its text (zeros where there is none), 1."""
    out = np.zeros((len(f), WIDTH), dtype=np.float32)
    out[:, :OWN] = f
    same = _inside(bounds)
    out[1:, OWN : 2 * OWN][same] = f[:-1][same]
    out[:-1, 2 * OWN : 3 * OWN][same] = f[1:][same]
    out[:, -1] = 1
    return out


def _inside(bounds: np.ndarray) -> np.ndarray:
    """For each line but the first, whether the line before belongs to the same text."""
    same = np.ones(max(int(bounds[-1]) - 1, 0), dtype=bool)
    same[bounds[1:-1] - 1] = False
    return same


@dataclass
class Crf:
    weights: np.ndarray  # WIDTH: what speaks for good
    same: np.ndarray  # scores of the transitions bad-bad and good-good; a change scores 0
    scale: tuple[float, float] = (1.0, 0.0)  # of the logit of the weighted marginals, so that scores are probabilities

    def unary(self, f: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """What each line and its neighbours say for good, from the lines' own features."""
        own, before, after = (f @ self.weights[k * OWN : (k + 1) * OWN] for k in range(3))
        same, out = _inside(bounds), own + self.weights[-1]
        out[1:][same] += before[:-1][same]
        out[:-1][same] += after[1:][same]
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Length-weighted marginals of each text; a text without words scores 0."""
        f, size, bounds = line_features(data, offsets)
        if not len(f):
            return np.zeros(0)
        weight = size * (f[:, 12] == 0)
        p = forward_backward(self.unary(f, bounds), self.same, bounds)[0]
        total = np.add.reduceat(weight, bounds[:-1]).astype(np.float64)
        z = _logit(np.add.reduceat(weight * p, bounds[:-1]), total)
        return np.where(total > 0, 1 / (1 + np.exp(-self.scale[0] * z - self.scale[1])), 0.0)


def _logit(good: np.ndarray, total: np.ndarray) -> np.ndarray:
    share = np.clip(np.where(total > 0, good / np.maximum(total, 1), 0.5), 1e-6, 1 - 1e-6)
    return np.log(share / (1 - share))


def forward_backward(unary: np.ndarray, same: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P(good) of each line, expected bad-bad and good-good transitions of each text, log partition of each text).

    unary: the score of good against bad. Texts are taken longest first, so that the texts still going at a
    line are a prefix; messages are normalised at each line.
    """
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    start, length = bounds[:-1][order], lengths[order]
    n, longest = len(order), int(length[0]) if len(order) else 0
    going = np.searchsorted(-length, -np.arange(1, longest + 1), side="right")  # texts with a line at each step
    u = np.clip(unary.astype(np.float64), -40, 40)
    phi = np.stack([np.ones_like(u), np.exp(u)], axis=1)
    t = np.array([[np.exp(same[0]), 1.0], [1.0, np.exp(same[1])]])
    alpha, scale = np.empty_like(phi), np.empty(len(u))
    for step in range(longest):
        at = start[: going[step]] + step
        a = phi[at] if step == 0 else (alpha[at - 1] @ t) * phi[at]
        scale[at] = a.sum(axis=1)
        alpha[at] = a / scale[at][:, None]
    log_z = np.zeros(n)
    log_z[order] = np.add.reduceat(np.log(scale), bounds[:-1])[order] if len(u) else 0
    p, pairs = np.empty(len(u)), np.zeros((n, 2))
    beta = np.ones((n, 2))
    for step in range(longest - 1, -1, -1):
        k = going[step]
        at = start[:k] + step
        joint = alpha[at] * beta[:k]
        p[at] = joint[:, 1] / joint.sum(axis=1)
        if step:
            message = phi[at] * beta[:k] / scale[at][:, None]
            for s in (0, 1):
                pairs[order[:k], s] += alpha[at - 1][:, s] * t[s, s] * message[:, s]
            beta[:k] = message @ t.T
    return p, pairs, log_z


def fit(x: np.ndarray, bounds: np.ndarray, owner: np.ndarray, good: np.ndarray, sizes: np.ndarray, l2: float = 1.0, steps: int = 250) -> Crf:
    """Maximum likelihood of the line labels (each line has its document's) by Adam.

    Stretches of lines lie between bounds; owner has each stretch's document, good the documents' labels. A
    document's lines together weigh no more than ten lines, so long ones do not outweigh the rest.
    """
    lengths = np.diff(bounds)
    document = np.repeat(owner, lengths)
    weight = np.minimum(1.0, 10 / np.maximum(np.bincount(document, minlength=len(good)), 1))
    y = good[document].astype(np.float64)
    theta = np.zeros(x.shape[1] + 2)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    moves, kind = np.maximum(lengths - 1, 0), good[owner]
    x64 = x.astype(np.float64)
    for step in range(1, steps + 1):
        p, pairs, _ = forward_backward(x64 @ theta[:-2], theta[-2:], bounds)
        g = np.concatenate([x64.T @ ((p - y) * weight[document]), ((pairs - np.stack([moves * (1 - kind), moves * kind], axis=1)) * weight[owner][:, None]).sum(axis=0)])
        g += l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta[-2:] = np.clip(theta[-2:], -4, 4)
    model = Crf(theta[:-2], theta[-2:])
    p = forward_backward(x64 @ theta[:-2], theta[-2:], bounds)[0]
    size = sizes * (x[:, 12] == 0)
    total = np.bincount(document, weights=size, minlength=len(good))
    z = _logit(np.bincount(document, weights=size * p, minlength=len(good)), total)
    model.scale = _platt(z[total > 0], good[total > 0])
    return model


def _platt(z: np.ndarray, y: np.ndarray, l2: float = 1.0) -> tuple[float, float]:
    """Slope and offset of a logistic regression on one column, by Newton steps, with softened targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - target) * z).sum() + l2 * (a - 1), (p - target).sum() + l2 * b])
        h = np.array([[(w * z * z).sum() + l2, (w * z).sum()], [(w * z).sum(), w.sum() + l2]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -1, 1)
    return max(float(a), 0.01), float(b)


def stretches(lines: int) -> list[tuple[int, int]]:
    """The line ranges of a text that are learned from: all of it, or evenly spaced ones."""
    if lines <= STRETCHES * STRETCH:
        return [(0, lines)]
    return [(a, a + STRETCH) for a in (k * (lines - STRETCH) // (STRETCHES - 1) for k in range(STRETCHES))]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Crf:
    """A model from a bounded sample of labelled rows, as labelled_sample says, of texts of any length.

    Features are made by the executors from whole texts; of a text of very many lines some stretches of lines are
    learned from, so that what reaches the driver is bounded by rows and by lines. Other columns are not looked at.
    Without labelled rows, or with empty tables, every line is as likely good as bad.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for i, j in slices(offsets, CHUNK):
                f, size, bounds = line_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                rows = []
                for t, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True), i):
                    for n, m in stretches(b - a):
                        low, high = max(n - 1, 0), min(m + 1, b - a)  # with the neighbours, whose features count too
                        x = with_neighbours(f[a + low : a + high], np.array([0, high - low]))[n - low : m - low]
                        rows.append((t, x.tobytes(), size[a + n : a + m].astype("<i8").tobytes()))
                at = pa.array([r[0] for r in rows])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["id", "good", "x", "size"])

    sample = labelled_sample(docs, labels, "quality", sample_rows)
    got = map_batches(sample.select(F.col("doc_id").cast("long"), "mark", "text"), run, "id long, good int, x binary, size binary").toPandas()
    if not len(got):
        return Crf(np.zeros(WIDTH), np.zeros(2))
    got = got.sort_values(["id", "x"], kind="stable")
    ids, owner = np.unique(got["id"].to_numpy(), return_inverse=True)
    good = np.zeros(len(ids))
    good[owner] = got["good"].to_numpy(np.float64)
    xs = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in got["x"]]
    sizes = np.concatenate([np.frombuffer(b, "<i8") for b in got["size"]])
    return fit(np.concatenate(xs), np.concatenate([[0], np.cumsum([len(x) for x in xs])]), owner, good, sizes)


def score(docs: DataFrame, model: Crf, text_col: str = "text", name: str = "quality_score") -> DataFrame:
    """docs with the score of whole texts added: null, empty and blank texts score 0, repeated rows alike, null ids like others;
    no rows give none. A column of that name is replaced. No shuffle."""
    from pyspark.sql import types as T

    docs = docs.drop(name)
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            got = [shared.value.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets, CHUNK)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(got) if got else np.zeros(0))], names=[*batch.schema.names, name])

    return map_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of all documents; odd rows as train and score say, a null id is not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")), name="score")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
