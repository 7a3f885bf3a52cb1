"""Forest recall against brute force, the random field against enumeration, held-out accuracy of both classifiers, edges."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factorspark.llm import forest, quality, toxicity
from factorspark.llm.common import text_bytes

SF = "/root/testdata/sf0.01"


def exact(ids, x, q, k):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u[q]
    s[q] = -9
    return [(int(ids[i]), s[i]) for i in np.lexsort((ids, -s))[:k]]


@pytest.mark.parametrize("block", [300, 4096])
def test_forest_recall_and_scores(spark, monkeypatch, block):
    monkeypatch.setattr(forest, "BLOCK_ROWS", block)
    monkeypatch.setattr(forest, "RANGE_ROWS", block)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 32))
    x[100:400] = x[7] + 0.05 * rng.normal(size=(300, 32))  # one crowded place
    x[500] = x[501] = x[502]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, id int")
    got = forest.nearest(df, df.where("vec_id % 25 = 0"), k=5).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == [1, 2, 3, 4, 5] and q not in set(g.id)
        assert g.sort_values(["score", "id"], ascending=[False, True]).id.tolist() == g.id.tolist()
        hits += len(set(g.id) & {i for i, _ in exact(np.arange(1500), x, q, 5)})
        for r in g.itertuples():
            assert abs(r.score - x[q] @ x[r.id] / np.linalg.norm(x[q]) / np.linalg.norm(x[r.id])) < 1e-12
    assert got.query_id.nunique() == 60 and hits / 300 >= 0.9


def test_forest_leaves_out_what_is_no_vector(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (8, []), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (10, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.id for r in forest.nearest(df, df, k=5).collect()}
    assert got == {(1, 1): 2, (1, 2): 10, (2, 1): 1, (2, 2): 10, (10, 1): 2, (10, 2): 1}
    assert forest.nearest(df.limit(0), df, k=5).count() == 0 and forest.nearest(df, df.limit(0), k=5).count() == 0


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    lengths = [1, 4, 3, 1, 6]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    unary, same = rng.normal(size=bounds[-1]), np.array([0.7, -0.4])
    p, pairs, log_z = quality.forward_backward(unary, same, bounds)
    for t, (a, b) in enumerate(itertools.pairwise(bounds)):
        total, good, moves = 0.0, np.zeros(b - a), np.zeros(2)
        for y in itertools.product((0, 1), repeat=b - a):
            s = np.exp(sum(unary[a + i] for i in range(b - a) if y[i]) + sum(same[u] for u, v in itertools.pairwise(y) if u == v))
            total += s
            good += s * np.array(y)
            for u, v in itertools.pairwise(y):
                if u == v:
                    moves[u] += s
        assert np.allclose(p[a:b], good / total) and np.allclose(pairs[t], moves / total) and abs(log_z[t] - np.log(total)) < 1e-9


def test_line_features_of_odd_texts():
    texts = ["", "\n", "a", "One two.\n\nTHREE!! three three", None, "é\n"]
    data, offsets = text_bytes(pa.array(texts))
    x, size, bounds = quality.line_features(data, offsets)
    assert np.diff(bounds).tolist() == [1, 2, 1, 3, 1, 2] and np.isfinite(x).all()
    assert size.tolist() == [0, 0, 0, 1, 8, 0, 19, 0, 2, 0]
    third = x[bounds[3] + 2]
    assert abs(third[6] - 2 / 3) < 1e-6 and abs(third[7] - 1 / 3) < 1e-6  # two distinct words of three, one repeated in a row
    data, offsets = text_bytes(pa.array(["x y\n" * 3, "q"]).slice(1))
    assert quality.line_features(data, offsets)[2].tolist() == [0, 1]


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n "), (-4, "word " * 400_000)], "doc_id long, text string")
    got = quality.score(docs.select("doc_id", "text").unionByName(more), model).toPandas().set_index("doc_id").quality_score
    assert got.between(0, 1).all() and (got[[-1, -2, -3]] == 0).all()
    y = labels.toPandas().set_index("doc_id").quality
    held = [i for i in y.index if zlib.crc32(str(i).encode()) % 5 == 0]
    s, t = got[held].to_numpy(), y[held].to_numpy()
    assert (s[t == 1][:, None] > s[t == 0][None, :]).mean() > 0.97 and ((s >= 0.3) == t).mean() > 0.93


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    chain = toxicity.train(docs, labels)
    got = toxicity.score(docs.select("doc_id", "text"), chain).toPandas().set_index("doc_id").p_toxic
    y = labels.toPandas().set_index("doc_id").toxic
    held = [i for i in y.index if zlib.crc32(str(i).encode()) % 5 == 0]
    p, t = got[held].to_numpy() >= toxicity.THRESHOLD, y[held].to_numpy()
    assert p[t == 1].mean() > 0.9 and p[t == 0].mean() < 0.01


def test_chain_feeds_earlier_probabilities():
    rng = np.random.default_rng(3)
    n = 400
    first = rng.integers(0, 2, n)
    rows = np.flatnonzero(first)
    y = np.stack([first, first], axis=1).astype(float)
    chain = toxicity.fit_chain(rows, np.zeros(len(rows), np.int64), np.stack([y] * 6), np.arange(n) % 5, np.ones((6, 1), bool), np.array([5], np.uint64))
    assert chain.weights[1, 1] > 0.5  # the second model uses the first one's probability
    p = chain.predict(np.array([0]), np.array([0]), 2)
    assert p[0, 1] > 0.8 > 0.2 > p[1, 1]


def test_classifiers_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None), (1, "a b")], "doc_id long, text string").withColumn("p_toxic", F.lit("x")).withColumn("quality_score", F.lit("x"))
    none = spark.createDataFrame([(5, None, None)], "doc_id long, quality int, toxic int")
    model, chain = quality.train(docs, none), toxicity.train(docs, none)
    assert quality.score(docs, model).count() == 3 and toxicity.score(docs, chain).where("p_toxic < 0.3").count() == 3
    assert quality.score(docs.limit(0), model).count() == 0 and toxicity.score(docs.limit(0), chain).count() == 0
