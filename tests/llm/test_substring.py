"""Removal of repeated windows against a scan with a set of all windows, also with hot minimisers and small buckets."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorspark.llm import substring


def brute(rows, k):
    seen, out = {}, []
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = (t or "").encode().split()
        keep = [True] * len(words)
        for s in range(len(words) - k + 1):
            w = tuple(words[s : s + k])
            if seen.setdefault(w, (i, s)) != (i, s):
                keep[s : s + k] = [False] * k
        out.append((i, len(words), [w for w, y in zip(words, keep, strict=True) if y]))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "Ab", "c", "éé", "d\x1fe", "x" * 40, *map(str, range(60))])
    passages = [[word() for _ in range(n)] for n in (25, 60, 31)]
    rows = []
    for i in range(150):
        words = [word() for _ in range(rng.randrange(60))]
        for p in passages:
            if rng.random() < 0.4:
                at = rng.randrange(len(words) + 1)
                words[at:at] = p
        rows.append((i * 3, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(1, "the " * 120), (2, "a b c " * 50), (4, None), (5, ""), (7, rows[0][1]), (8, rows[0][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k,m,hot,bucket", [(20, 4, 2000, 1 << 24), (20, 4, 4, 2000), (8, 3, 2, 500)])
def test_equals_a_full_scan(spark, monkeypatch, k, m, hot, bucket):
    monkeypatch.setattr(substring, "HOT_COUNT", hot)
    monkeypatch.setattr(substring, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(substring, "_CHUNK", 20_000)
    rows = corpus(k + hot)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit(9)).repartition(3)
    got = {r.doc_id: r for r in substring.remove_repeats(df, k, m, digest=True).collect()}
    assert len(got) == len(rows)
    for i, n, kept in brute(rows, k):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()), i


def test_texts_keep_their_form_where_nothing_goes(spark):
    rows = [(1, "one  two\n three"), (2, None), (None, "x " * 30), (None, "x " * 30), (3, "p q r s t u " * 2), (3, "p q r s t u " * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_removed", F.lit("old"))
    got = substring.remove_repeats(df.drop("n_removed"), 6, 2).collect()
    by = {(r.doc_id, r.text, r.n_removed) for r in got}
    assert (1, "one  two\n three", 0) in by and (2, None, 0) in by and (None, "x " * 30, 0) in by
    assert {(r.text, r.n_removed) for r in got if r.doc_id == 3} == {("p q r s t u", 6)}
    assert substring.remove_repeats(df.limit(0), digest=True).count() == 0


def test_hash_collisions_do_not_matter():
    data = np.frombuffer(b"ab cd ab ef", np.uint8)
    starts, ends = np.array([0, 3, 6, 9]), np.array([2, 5, 8, 11])
    ids = substring.exact_ids(data, starts, ends, np.zeros(4, np.uint64))
    assert ids[0] == ids[2] and len(set(ids.tolist())) == 3
    assert substring.sliding_min(np.array([5, 3, 4, 1, 9]), 3).tolist() == [3, 1, 1]


def test_packed_groups_come_back():
    rng = np.random.default_rng(3)
    for n in (1, 7, 500):
        low, docs, place, inner = rng.integers(0, 2**32, n, dtype=np.uint64), rng.integers(-(2**62), 2**62, n), rng.integers(0, 2**31, n), rng.random(n) < 0.5
        parts = [bytes(rng.integers(32, 250, rng.integers(1, 60), dtype=np.uint8)) for _ in range(n)]
        got = substring._unpack(substring._pack(low, docs, place, inner, parts))
        want = (low & np.uint64(0xFFFFFF), docs, place, inner, np.frombuffer(b"\n".join(parts), np.uint8), [len(p) for p in parts])
        assert all((np.asarray(a) == np.asarray(b)).all() for a, b in zip(got, want, strict=True))


def test_windows_meet_whatever_space_parts_their_words(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [sep.join(words) for sep in (" ", "\n", "\t\x0b", "\r\n\x0c ")]
    got = substring.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().set_index("doc_id")
    assert got.n_removed.to_dict() == {0: 0, 1: 60, 2: 60, 3: 60}


def test_rows_go_out_piece_by_piece(spark, monkeypatch):
    rows = corpus(3) + [(2000 + i, "same word " * (3_000 * i)) for i in range(4)]
    df = spark.createDataFrame([(i, t, j) for j, (i, t) in enumerate(rows)], "doc_id long, text string, n long").coalesce(1)
    whole = sorted(substring.remove_repeats(df).collect(), key=lambda r: r.n)
    monkeypatch.setattr(substring, "_CHUNK", 100)
    assert sorted(substring.remove_repeats(df).collect(), key=lambda r: r.n) == whole and len(whole) == len(rows)
    want = {i: (b" ".join(kept).decode(), n - len(kept)) for i, n, kept in brute(rows, 20)}
    assert all((r.text, r.n_removed) == want[r.doc_id] for r in whole if r.n_removed)
    assert all(want[r.doc_id][1] == 0 for r in whole if not r.n_removed)
