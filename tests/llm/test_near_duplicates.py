"""Near-duplicate components against all pairs, also where components are larger than a block."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorspark.llm import common, minhash
from factorspark.llm.common import components


def brute(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=0):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    base = [[word() for _ in range(rng.randrange(1, 90))] for _ in range(25)]
    rows = []
    for b in base:
        for _ in range(rng.randrange(1, 9)):
            c = [word() if rng.random() < rng.choice([0, 0.02, 0.05, 0.1]) else w for w in b]
            rows.append(" ".join(c).upper() if rng.random() < 0.2 else "\t".join(c))
    one = [word() for _ in range(70)]
    for _ in range(80):  # one large group whose members differ by up to a dozen edits
        c = list(one)
        for _ in range(rng.randrange(12)):
            c[rng.randrange(70)] = word()
        rows.append(" ".join(c))
    return list(enumerate([*rows, None, "", " \n ", "x", "X", "x", "été", "ÉTÉ"]))


@pytest.mark.parametrize("n,block", [(2, 512), (2, 9), (5, 20)])
def test_components_equal_all_pairs(spark, monkeypatch, n, block):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block)
    rows = corpus(n)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("rep", F.lit(0))
    got = {r.doc_id: r for r in minhash.near_duplicates(df, n=n).collect()}
    for i, (size, component) in brute(rows, n, 80).items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (size, component, component == i), i


def test_many_blocks_are_compared_in_groups(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 4)
    monkeypatch.setattr(minhash, "GROUPS", 3, raising=False)
    dealt, links, across = {}, minhash._links, minhash._across_blocks
    monkeypatch.setattr(minhash, "_links", lambda rows, *a, **b: (dealt.update(rows=rows.count()) if b.get("probed") else None, links(rows, *a, **b))[1])
    monkeypatch.setattr(minhash, "_across_blocks", lambda large, *a: (dealt.update(large=large.count()), across(large, *a))[1])
    rows = corpus(2)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=2).collect()}
    assert got == {i: component for i, (_, component) in brute(rows, 2, 80).items()}
    assert 0 < dealt["rows"] <= 2 * 3 * dealt["large"]  # every text at most once for each group and each slice


def test_repeated_null_and_no_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (3, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df, n=2).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, False), (3, 3, True), (3, 3, True)], key=str) or got[-1][0] is None
    assert minhash.near_duplicates(df.limit(0), n=2).count() == 0


def test_estimate_follows_jaccard():
    rng = np.random.default_rng(1)
    for j in (0.2, 0.5, 0.8, 0.95):
        both = round(2000 * j / (1 + j))
        errors = []
        for _ in range(30):
            x = rng.integers(0, 2**63, 2000 - both, dtype=np.uint64)
            a, b = np.split(x, [(len(x)) // 2])
            common = rng.integers(0, 2**63, both, dtype=np.uint64)
            a, b = np.concatenate([a, common]), np.concatenate([b, common])
            true = both / (len(a) + len(b) - both)
            equal = (minhash.registers(minhash.sketch(a)) == minhash.registers(minhash.sketch(b))).sum()
            errors.append(minhash.estimate(np.array(equal), np.array(len(a)), np.array(len(b))) - true)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


@pytest.mark.parametrize("task_edges", [0, 1_000_000])
def test_components_of_chains_stars_and_loops(spark, monkeypatch, task_edges):
    monkeypatch.setattr(common, "TASK_EDGES", task_edges)
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(500, 500), (None, 3), (3, None)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}
