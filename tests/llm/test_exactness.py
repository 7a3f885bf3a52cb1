"""Exactness where hashes meet: words that share one, ties, queries against brute force, mixtures, archives, odd rows in the pipeline."""

import gzip
import math
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from factorspark.llm import common, forest, mih, minhash, packing, quality, toxicity, warc
from factorspark.llm.common import text_bytes
from tests.llm.test_near_duplicates import brute

SMALL = "/root/testdata/sf0.001"


def alike(a="a", b="b", times=10):
    """Two words that polynomials modulo powers of two hash alike."""
    for _ in range(times):
        a, b = a + b, b + a
    return a, b


def test_words_that_polynomials_confuse(spark):
    s, t = alike()
    texts = [f"{s} z", f"{t} z", f"{s} z {t} z", f"{s} z {s} z", f"prefixed{s}", f"prefixed{t}", f"{t} Z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, n=2).collect()}
    assert got == brute(list(enumerate(texts)), 2, 80) and got[2][0] == 3 and got[6] == (1, 1)
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = packing.tokenizer(path)
    for r in packing.tokenize(df.withColumn("source", F.lit("s")).coalesce(1), path).collect():
        assert list(struct.unpack(f"<{r.n}H", r.ids)) == [*tok.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]


def test_colliding_hashes_change_nothing(monkeypatch):
    texts = ["a b c a b", "b a c", "x", "x y", "", "a b c a b d", "é é é", "c a b"] * 3
    data, offsets = text_bytes(pa.array(texts))
    want = [(len({tuple(w[k : k + 2]) for k in range(len(w) - 1)}) if len(w) > 1 else len(w)) for w in (t.split() for t in texts)]
    few = lambda f: lambda *a, **b: f(*a, **b) % np.uint64(3)
    monkeypatch.setattr(minhash, "hash_words", few(common.hash_words))
    assert [n for _, n, _ in minhash.shingle_sets(data, offsets, 2)] == want
    flat, sizes = minhash.exact_shingles([t.encode() for t in texts], 2)
    assert sizes.tolist() == want
    at = np.concatenate([[0], np.cumsum(sizes)])
    sets = [set(flat[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert sets[0] == sets[8] and len(sets[0] & sets[5]) == 3 and len(sets[0] & sets[1]) == 0 and not sets[2] & sets[3]
    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "mix", few(common.mix))
    memo = packing.WordMemo(path)
    for _ in range(2):  # the second time, words meet others of their hash in the memo
        ids, at = memo.encode(data, offsets, 1)
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == [*memo.tokenizer.encode(t, add_special_tokens=False).ids, 1]


def test_equal_vectors_score_alike_anywhere(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 37))
    same = np.sort(rng.choice(np.arange(1, 3000), 400, replace=False))
    x[same] = x[same[0]]
    x[same[5]] = x[same[0]] * 4  # equal cosines, other components
    x[0] = x[same[0]] + 0.01 * rng.normal(size=37)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    got = forest.nearest(df, df.where(F.col("vec_id").isin([0, int(same[300]), int(same[5])])), k=7).toPandas()
    near = {q: g.sort_values("rank") for q, g in got.groupby("query_id")}
    first = [int(i) for i in same]
    assert near[0].id.tolist() == first[:7] and near[0].score.nunique() == 1
    assert near[first[300]].id.tolist() == first[:7] and near[first[5]].id.tolist() == [i for i in first[:8] if i != first[5]]


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1", "check_h"])
def test_recall_on_the_tables(spark, folder):
    rows = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet").where("embedding is not null").select("vec_id", "embedding").toPandas()
    x = {int(i): np.array(v, np.float64) for i, v in zip(rows.vec_id, rows.embedding, strict=True) if all(c is not None and np.isfinite(c) for c in v) and any(v)}
    ids = np.array(sorted(x))
    u = np.stack([x[i] / np.linalg.norm(x[i]) for i in ids.tolist()])
    got = {q: g.sort_values("rank") for q, g in forest.op1_forest(spark, f"/root/testdata/{folder}").toPandas().groupby("query_id")}
    hits, queries = 0, ids[ids % 50 == 0]
    for q in queries.tolist():
        s = u @ u[np.searchsorted(ids, q)]
        s[np.searchsorted(ids, q)] = -9
        hits += (got[q].score.to_numpy() >= np.sort(s)[-5] - 1e-9).sum()
        assert all(abs(r.score - s[np.searchsorted(ids, r.vec_id)]) < 1e-12 for r in got[q].itertuples())
    assert hits / 5 / len(queries) >= 0.9


def test_a_scan_ends_a_search_that_would_probe_more_than_there_is(spark, monkeypatch):
    rng = np.random.default_rng(8)
    codes = [*(int(c) for c in rng.integers(0, 256, 70)), *(int(c) for c in rng.integers(-(2**63), 2**63, 300))]
    df = spark.createDataFrame(list(enumerate(codes)), "id long, code long")
    scans = []
    monkeypatch.setattr(mih, "_scan", lambda *a, f=mih._scan: scans.append(1) or f(*a))
    monkeypatch.setattr(mih, "BLOCK_CODES", 100)
    got = {(r.query_id, r["rank"]): (r.id, r.hamming) for r in mih.hamming_top_k(df, df.where("id % 3 = 0"), k=90).collect()}
    want = {}
    for q in range(0, len(codes), 3):
        near = sorted(((codes[q] ^ c) & (2**64 - 1)).bit_count() * 1000 + i for i, c in enumerate(codes) if i != q)[:90]
        want |= {(q, k + 1): (d % 1000, d // 1000) for k, d in enumerate(near)}
    assert got == want and scans


def test_archives_are_cut_by_bytes_and_written_alike_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "STRETCH_BYTES", 3000)
    monkeypatch.setattr(warc, "STRETCHES", 2)
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"{i}" * 700) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    records = warc.mark_revisits(warc.convert_arcs(warc.arcs_of_pages(pages)).withColumn("key", warc.page_key()), "key").drop("key").coalesce(1)
    texts = []
    for name in "ab":
        warc.write_warc(records, f"file://{tmp_path}/{name}")
        files = [gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / name).glob("*.gz"))]
        assert len(files) > 5 and all(f.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and len(f) < 12_000 for f in files)
        texts.append(sorted(files))
        assert warc.read_warc(spark, f"file://{tmp_path}/{name}").count() == 40
    assert texts[0] == texts[1]


def test_given_shares_hold_while_sources_last(spark):
    rows = [(i, "abc"[i % 3], 300, struct.pack("<300H", *range(300))) for i in range(900)]
    tokens = spark.createDataFrame(rows, "doc_id long, source string, n long, ids binary")
    pieces = packing.pack(tokens, length=1024, shares={"a": 0.6, "b": 0.3, "c": 0.1}, shard_tokens=90_000).toPandas()
    source = {i: s for i, s, *_ in rows}
    parts = defaultdict(lambda: defaultdict(int))
    for p in pieces.itertuples():
        parts[p.sequence_id][source[p.doc_id]] += p.length
    assert sum(sum(x.values()) for x in parts.values()) == 270_000
    for shard in {q >> 32 for q in parts}:
        first = [parts[(shard << 32) + k] for k in range(20)]  # a lasts for some 48 windows of a shard
        for s, share in (("a", 0.6), ("b", 0.3), ("c", 0.1)):
            assert abs(sum(x[s] for x in first) / 20 / 1024 - share) < 0.12, (shard, s)


def test_debts_are_carried_whole_and_paid_in_instalments():
    got = []
    mixer = packing.Mixer(1000, lambda d, a, n, ids, seq, off: got.append((seq, d, n)), {"a": 0.5, "b": 0.5}, {"a": 5000.0, "b": -5000.0})
    for s in "ab":
        for _ in range(200):
            mixer.add(s, s, struct.pack("<250H", *[7] * 250))
    mixer.windows(last=True)
    a = defaultdict(int)
    for seq, s, n in got:
        a[seq] += n * (s == "a")
    assert all(550 <= a[k] <= 700 for k in range(1, 35)) and sum(a[k] for k in range(40)) == pytest.approx(20_000 + 5000, abs=300)
    assert all(400 <= a[k] <= 600 for k in range(45, 70))


def test_rows_of_one_id_are_spread_over_shards(spark):
    rows = [(None if i % 2 else 7, "s", 300, struct.pack("<300H", *range(300))) for i in range(600)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, source string, n long, ids binary"), length=1024, shard_tokens=20_000)
    by = pieces.groupBy((F.col("sequence_id") / 2**32).cast("int").alias("shard")).agg(F.sum("length").alias("n")).toPandas()
    assert by.n.sum() == 180_000 and len(by) == 9 and by.n.max() < 2 * by.n.mean()


# -- classifiers against plain versions of themselves ---------------------------------------------------------------


def plain_line(line: bytes) -> list[float]:
    marks = b".,;:?'\"-()"
    upper = lambda b: 65 <= b <= 90
    letter = lambda b: upper(b) or 97 <= b <= 122 or b >= 0x80
    kinds = [upper, letter, lambda b: 48 <= b <= 57, lambda b: b in marks, lambda b: b == 33, lambda b: 33 <= b < 127 and not (letter(b) or 48 <= b <= 57 or b in marks or b == 33)]
    n, words = max(len(line), 1), re.findall(rb"[^\x20\x09-\x0d]+", line)
    k = max(len(words), 1)
    out = [sum(map(f, line)) / n for f in kinds]
    out += [len(set(words)) / k, sum(a == b for a, b in zip(words, words[1:], strict=False)) / k, sum(not any(map(letter, w)) for w in words) / k, sum(2 * sum(map(upper, w)) > len(w) for w in words) / k]
    return [*out, min(sum(map(len, words)) / k / 10, 5), math.log1p(len(words)) / 5, float(not words), float(line.endswith(b"."))]


def plain_quality(text: str, model: quality.Crf) -> float:
    lines = text.encode().split(b"\n")
    own = [plain_line(x) for x in lines]
    none, w, o = [0.0] * quality.OWN, model.weights, quality.OWN
    u = [float(np.dot(own[i] + (own[i - 1] if i else none) + (own[i + 1] if i + 1 < len(own) else none) + [1.0], w[: 3 * o + 1])) for i in range(len(own))]
    phi, t = [(1.0, math.exp(min(max(x, -40), 40))) for x in u], [[math.exp(model.same[0]), 1.0], [1.0, math.exp(model.same[1])]]
    alpha, beta = [], [(1.0, 1.0)] * len(u)
    for i, f in enumerate(phi):
        a = [f[s] * (sum(alpha[i - 1][r] * t[r][s] for r in (0, 1)) if i else 1.0) for s in (0, 1)]
        alpha.append([x / sum(a) for x in a])
    for i in range(len(u) - 2, -1, -1):
        b = [sum(t[s][r] * phi[i + 1][r] * beta[i + 1][r] for r in (0, 1)) for s in (0, 1)]
        beta[i] = [x / sum(b) for x in b]
    good = [alpha[i][1] * beta[i][1] / (alpha[i][0] * beta[i][0] + alpha[i][1] * beta[i][1]) for i in range(len(u))]
    size = [len(x) * (not f[12]) for x, f in zip(lines, own, strict=True)]
    if not sum(size):
        return 0.0
    share = min(max(sum(g * n for g, n in zip(good, size, strict=True)) / sum(size), 1e-6), 1 - 1e-6)
    return 1 / (1 + math.exp(-model.scale[0] * math.log(share / (1 - share)) - model.scale[1]))


def test_quality_query_equals_a_plain_version(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = entry.queries()["op8_quality"](spark, SMALL).toPandas().set_index("doc_id")
    texts = docs.toPandas().set_index("doc_id").text
    assert len(got) == len(texts)
    for i, t in texts.items():
        want = plain_quality(t or "", model)
        assert abs(got.score[i] - want) < 1e-4, i
        assert got.held_out[i] == (zlib.crc32(str(i).encode()) % 5 == 0) and got.predicted[i] == (got.score[i] >= 0.3)


def test_long_texts_are_learned_from_in_stretches(spark):
    docs = spark.createDataFrame([(1, "One good line.\n" * 5000), (2, "!! BUY $$ 1\n" * 3000), (3, "A fine short text."), (4, "$$$ !!!")] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 5)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.train(docs, labels)).toPandas().groupby("doc_id").quality_score.mean()
    assert quality.stretches(100) == [(0, 100)] and quality.stretches(5001) == [(0, 25), (1658, 1683), (3317, 3342), (4976, 5001)]
    assert got.between(0, 1).all() and got[1] > got[2]


def test_toxicity_query_equals_a_plain_version(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    chain = toxicity.train(docs, labels)
    got = entry.queries()["op9_toxicity"](spark, SMALL).toPandas().set_index("doc_id")
    texts = docs.toPandas().set_index("doc_id").text
    weights = {int(h): chain.weights[:, k] for k, h in enumerate(chain.hashes)}
    seen: dict[bytes, set[int]] = {}
    assert len(weights) > 20
    for i, t in texts.items():
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())
        hashes = set()
        for word in re.findall(rb"[a-z\x80-\xff]+", low):
            if word not in seen:
                seen[word] = set(toxicity.features(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[1].tolist())
            hashes |= seen[word]
        p: list[float] = []
        for c in range(3):
            z = sum(weights[h][c] for h in hashes if h in weights) + sum(x * chain.weights[c, len(weights) + k] for k, x in enumerate(p)) + chain.weights[c, -1]
            p.append(1 / (1 + math.exp(-min(max(z, -30), 30))))
        assert np.allclose(got.loc[i, ["p_word", "p_family", "p_toxic"]].to_numpy(float), p, atol=1e-9), i
        assert got.toxic[i] == (got.p_toxic[i] >= toxicity.THRESHOLD)


def test_samples_are_the_same_whatever_the_order(spark):
    rows = [(i % 40, f"text {i}") for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(45)], "doc_id long, quality int, b boolean")
    a, b = (common.labelled_sample(spark.createDataFrame(rows[::s], "doc_id long, text string").repartition(4 + s), labels, "quality", 9) for s in (1, -1))
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() <= 9


def test_a_fold_decides_nothing_about_itself():
    rows, cols = np.array([0, 1, 2, 3]), np.array([0, 0, 1, 1])
    toxic = np.array([True, True, True, False])
    lifts, kinds = np.array([2.0, -np.inf]), np.array([0, 1])
    got = toxicity.categories(rows, cols, toxic, lifts, kinds)
    assert got.tolist() == [[1, 0, 1], [1, 0, 1], [0, 0, 1], [0, 0, 0]]


# -- the pipeline's stages on odd rows ---------------------------------------------------------------------------


def test_stages_on_odd_rows(spark, tmp_path):
    long_ = " ".join(f"w{i}" for i in range(60))
    kinds = "doc_id long, text string, lang string, source string, n_chars long, n_removed string, p_toxic string, quality_score string, kept int"
    rows = [(1, long_, None, "s"), (2, None, "en", None), (2, None, "en", None), (None, long_, None, "s"), (4, long_, "en", "s"), (5, "new words here " + long_, "en", "t"), (6, "", "en", "t"), (7, "a b c d " * 9, "en", "t")]
    docs = spark.createDataFrame([(*r, 5, "mine", "mine", "mine", 3) for r in rows], kinds)
    spark.createDataFrame([(1, 1, 0), (4, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    out = corpus_pipeline.toxic_out(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and ids(out) == [1, 2, 2, 4, 5, 6, 7, None] and {r.p_toxic for r in out.collect()} == {"mine"}
    out = corpus_pipeline.quality_out(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and ids(out) == [1, 4, 5, 7, None] and {r.quality_score for r in out.collect()} == {"mine"}
    out = corpus_pipeline.near_duplicates_out(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and ids(out) == [1, 2, 2, 6, 7, None] and {r.kept for r in out.collect()} == {3}
    out = corpus_pipeline.repeats_out(spark, docs, str(tmp_path))
    got = {(r.doc_id, r.text, r.n_chars) for r in out.collect()}
    assert out.columns == docs.columns and {r.n_removed for r in out.collect()} == {"mine"}
    # Of 36 words in a cycle of four, windows from the fifth on start earlier too: the first four words stay.
    assert got == {(1, long_, len(long_)), (2, None, None), (None, long_, len(long_)), (4, "", 0), (5, "new words here", 14), (6, "", 0), (7, "a b c d", 7)}
    assert sum(r.length for r in corpus_pipeline.packed(spark, docs.where("doc_id is null or doc_id in (2, 6)"), str(tmp_path)).where("doc_id is not null").collect()) == 3
    last = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert {None if np.isnan(i) else int(i) for i in last.doc_id.astype(float)} == {1, None, 7}


def test_what_queries_wrote_on_their_way_is_removed(spark, tmp_path):
    before = len(common.WRITTEN)
    got = entry.queries()["op5_near_duplicates"](spark, SMALL)
    assert len(common.WRITTEN) == before + 1 and got.count() == 200
    assert entry.queries()["op7_warc"](spark, SMALL).count() == 50 and len(common.WRITTEN) == before + 2
