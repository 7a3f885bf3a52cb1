"""Operator 9: toxicity by a classifier chain of linear models on hashed words and word beginnings.

The categories are predicted one after the other; each model sees the probabilities of the categories before it.
For training these are out-of-fold predictions, so that a later model does not learn to trust an overfitted one: which
features count and what the earlier categories are is decided for each fold by the other folds alone.

Labels give only one mark. The chain's earlier categories are derived from it on the training rows: ``word`` (a
toxic document whose strongest indicator is a whole word) and ``family`` (one whose strongest is a word beginning, as
of inflected or made-up forms); the last category, ``toxic``, is the mark itself and decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.llm.common import BYTE_VALUE, CHUNK, hash_words, labelled_sample, map_batches, materialize, mix, scan_words, slices, table, text_bytes

CATEGORIES = ("word", "family", "toxic")
SAMPLE_ROWS = 12_000  # labelled rows that the chain is trained on
FEATURES = 4096
FOLDS = 5
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.3
#: Letters of ASCII in lower case and all bytes beyond ASCII make words, the rest separates.
_LETTERS = np.full(256, 0x20, dtype=np.uint8)
_LETTERS[0x80:] = np.arange(0x80, 256)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash): the hashed words and word beginnings of all texts. A hash's two lowest bits tell which of the four kinds it is."""
    low = _LETTERS[data]
    starts, ends, bounds = scan_words(low, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    kinds = [(text, hash_words(low, starts) & ~np.uint64(3))]
    length = ends - starts
    h = np.zeros(len(starts), dtype=np.uint64)
    for j in range(max(BEGINNINGS)):
        h = h + BYTE_VALUE[j][low[np.minimum(starts + j, len(low) - 1)]] if len(starts) else h
        if j + 1 in BEGINNINGS:
            has = length >= j + 1
            kinds.append((text[has], (mix(h[has]) & ~np.uint64(3)) | np.uint64(1 + BEGINNINGS.index(j + 1))))
    return np.concatenate([t for t, _ in kinds]), np.concatenate([x for _, x in kinds])


def _feature_rows(sample: DataFrame) -> DataFrame:
    """(doc_id, mark, fold, hash), each hash once a document, from a sample with one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(3))
            for i, j in slices(offsets, CHUNK):
                t, h = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                order = np.lexsort((h, t))
                t, h = t[order], h[order]
                first = np.ones(len(t), dtype=bool)
                first[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
                at = pa.array(t[first] + i)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), pa.array(h[first].view(np.int64))], names=["doc_id", "mark", "fold", "hash"])

    return map_batches(sample.select("doc_id", "mark", "fold", "text"), run, "doc_id long, mark int, fold int, hash long")


def logistic(rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, y: np.ndarray, width: int, l2: float = 0.02, steps: int = 300) -> np.ndarray:
    """Weights of a logistic regression over sparse 0/1 features (rows, cols), dense columns and a bias, by Adam on the whole sample."""
    n, extra = len(y), dense.shape[1]
    w = np.zeros(width + extra + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    base = np.clip(y.mean() if n else 0.0, 1e-4, 1 - 1e-4)
    w[-1] = np.log(base / (1 - base))
    for step in range(1, steps + 1):
        z = np.bincount(rows, weights=w[cols], minlength=n) + dense @ w[width:-1] + w[-1]
        r = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.concatenate([np.bincount(cols, weights=r[rows], minlength=width), dense.T @ r, [r.sum()]])
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Chain:
    hashes: np.ndarray  # sorted
    weights: np.ndarray  # one row a category: features, earlier categories, bias

    def predict(self, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
        """(n, categories): probabilities, fed forward along the chain."""
        width, out = len(self.hashes), np.zeros((n, len(self.weights)))
        for c, w in enumerate(self.weights):
            out[:, c] = _sigmoid(np.bincount(rows, weights=w[cols], minlength=n) + out[:, :c] @ w[width : width + c] + w[-1])
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        sieve = np.zeros(1 << 16, dtype=bool)
        sieve[(self.hashes >> np.uint64(48)).astype(np.int64)] = True
        text, h = features(data, offsets)
        maybe = sieve[(h >> np.uint64(48)).astype(np.int64)]
        text, h = text[maybe], h[maybe]
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        hit = self.hashes[at] == h if len(self.hashes) else np.zeros(0, bool)
        pairs = np.unique(text[hit] * len(self.hashes) + at[hit]) if hit.any() else np.zeros(0, np.int64)
        return self.predict(pairs // max(len(self.hashes), 1), pairs % max(len(self.hashes), 1), n)


def fit_chain(rows: np.ndarray, cols: np.ndarray, targets: np.ndarray, fold: np.ndarray, usable: np.ndarray, hashes: np.ndarray) -> Chain:
    """targets: (folds + 1, n, categories) of 0/1 and usable: (folds + 1, features), as seen without each fold and, last, by all rows.

    Out-of-fold probabilities of each category are the inputs of those after it.
    """
    folds, (n, k), width = len(targets) - 1, targets.shape[1:], len(hashes)
    oof, weights = np.zeros((n, k)), np.zeros((k, width + k))
    for c in range(k):
        for f in range(folds):
            train, test = np.flatnonzero(fold != f), fold == f
            if not test.any():
                continue
            new = np.full(n, -1)
            new[train] = np.arange(len(train))
            own = (new[rows] >= 0) & usable[f][cols]
            w = logistic(new[rows[own]], cols[own], oof[train][:, :c], targets[f, train, c], width)
            z = np.bincount(rows, weights=w[cols], minlength=n) + oof[:, :c] @ w[width:-1] + w[-1]
            oof[test, c] = _sigmoid(z)[test]
        own = usable[folds][cols]
        w = logistic(rows[own], cols[own], oof[:, :c], targets[folds, :, c], width)
        weights[c, : width + c], weights[c, -1] = w[:-1], w[-1]
    kept = usable[folds]
    return Chain(hashes[kept], np.concatenate([weights[:, :width][:, kept], weights[:, width:]], axis=1))


def categories(rows: np.ndarray, cols: np.ndarray, toxic: np.ndarray, lifts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """(n, categories) of 0/1 from the mark and the lifts (-inf: not a feature): by whether a word or a beginning is strongest."""
    best = np.full((len(toxic), 2), -np.inf)
    np.maximum.at(best, (rows, kinds[cols]), lifts[cols])
    word = toxic & (best[:, 0] >= best[:, 1]) & (best[:, 0] > 0)
    return np.stack([word, toxic & (best[:, 1] > best[:, 0]), toxic], axis=1).astype(np.float64)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Chain:
    """A chain from a bounded sample of labelled rows, as labelled_sample says, of texts of any length.

    Features are counted by fold in DataFrames. What reaches the driver is at most FEATURES hashes for each
    fold left out and for all rows, with their counts, and the sample's hits on them. Other columns are not looked
    at. Without labelled rows, or with empty tables, every probability is that of an empty model.
    """
    sample = labelled_sample(docs, labels, "toxic", sample_rows)
    sample = materialize(sample.select(F.col("doc_id").cast("long"), "mark", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS)).cast("int").alias("fold"), "text"), "tox-sample")
    rows = materialize(_feature_rows(sample), "tox-features")
    ids = sample.select("doc_id", "mark", "fold").orderBy("doc_id").toPandas()
    toxic, fold = ids["mark"].to_numpy() == 1, ids["fold"].to_numpy(np.int64)
    none = Chain(np.zeros(0, np.uint64), np.tile(np.append(np.zeros(len(CATEGORIES) - 1), -3.0), (len(CATEGORIES), 1)))
    if not toxic.any():
        return none
    sums = [F.sum(F.when(F.col("fold") == f, x).otherwise(0)).alias(f"{name}{f}") for f in range(FOLDS) for name, x in (("n", 1), ("t", F.col("mark")))]
    counts = materialize(rows.groupBy("hash").agg(*sums).where(" + ".join(f"t{f}" for f in range(FOLDS)) + " >= 2"), "tox-counts")
    tops = [_top(counts, left_out, toxic, fold).toPandas() for left_out in (*range(FOLDS), None)]
    hashes, first = np.unique(np.concatenate([t["hash"].to_numpy(np.int64) for t in tops]).view(np.uint64), return_index=True)
    if not len(hashes):
        return none
    by_fold = np.concatenate([t[[f"{name}{f}" for name in "nt" for f in range(FOLDS)]].to_numpy(np.float64) for t in tops])[first]
    usable = np.stack([np.isin(hashes, t["hash"].to_numpy(np.int64).view(np.uint64)) for t in tops])
    wanted = docs.sparkSession.createDataFrame([(int(h),) for h in hashes.view(np.int64)], "hash long")
    chosen = rows.join(F.broadcast(wanted), "hash").select("doc_id", "hash").toPandas()  # at most sample_rows * (FOLDS + 1) * FEATURES
    r = np.searchsorted(ids["doc_id"].to_numpy(np.int64), chosen["doc_id"].to_numpy(np.int64))
    c = np.searchsorted(hashes, chosen["hash"].to_numpy(np.int64).view(np.uint64))
    order = np.lexsort((c, r))
    r, c = r[order], c[order]
    kinds = ((hashes & np.uint64(3)) > 0).astype(np.int64)
    targets = []
    for k, left_out in enumerate((*range(FOLDS), None)):
        seen = [f for f in range(FOLDS) if f != left_out]
        lifts = lift(by_fold[:, seen].sum(axis=1), by_fold[:, [FOLDS + f for f in seen]].sum(axis=1), toxic[fold != left_out] if left_out is not None else toxic)
        targets.append(categories(r, c, toxic, np.where(usable[k], lifts, -np.inf), kinds))
    return fit_chain(r, c, np.stack(targets), fold, usable, hashes)


def lift(n, t, toxic: np.ndarray):
    """How much likelier a document with a feature is toxic than any, as a logarithm; n documents have it, t toxic ones."""
    log = np.log if isinstance(n, np.ndarray) else F.log
    return log((t + 0.1) / (n - t + 0.1)) - float(np.log((toxic.sum() + 1) / ((~toxic).sum() + 1)))


def _top(counts: DataFrame, left_out: int | None, toxic: np.ndarray, fold: np.ndarray) -> DataFrame:
    """The FEATURES strongest indicators by the folds not left out."""
    seen = [f for f in range(FOLDS) if f != left_out]
    n, t = (sum((F.col(f"{name}{f}") for f in seen), F.lit(0)) for name in "nt")
    own = lift(n, t, toxic[fold != left_out] if left_out is not None else toxic)
    return counts.withColumn("lift", own).where((t >= 2) & (F.col("lift") > 1)).orderBy(F.desc(F.col("lift") * F.sqrt(t)), "hash").limit(FEATURES)


def score(docs: DataFrame, chain: Chain, text_col: str = "text", prefix: str = "p_") -> DataFrame:
    """docs with a probability for each category added, p_word, p_family and p_toxic, from whole texts. No shuffle.

    Null texts count as empty, repeated rows score alike, null ids like others; no rows give none. A column of docs
    that already has one of these names is replaced; prefix is for other names.
    """
    from pyspark.sql import types as T

    names = [f"{prefix}{c}" for c in CATEGORIES]
    docs = docs.drop(*names)
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            got = [chain.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets, CHUNK)]
            p = np.concatenate(got) if got else np.zeros((0, len(names)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(p[:, k].copy()) for k in range(len(names)))], names=[*batch.schema.names, *names])

    return map_batches(docs, run, T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)]))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """(doc_id, p_word, p_family, p_toxic, toxic) of all documents; odd rows as train and score say."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "p_word", "p_family", "p_toxic", (F.col("p_toxic") >= THRESHOLD).alias("toxic"))
