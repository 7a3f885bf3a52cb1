"""Chat formatting, BPE, packing, WARC and Hamming search against brute force and round trips."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from factorspark.llm import bpe, chat, mih, packing, warc

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", " ", "Hello wörld, don't  stop\n\n\n 123abc", "<|endoftext|> ###", "x" + " " * 30_000 + "\ty", "né" * 5000, "a b " * 60_000, "　 " * 15000 + "z", "İ Σας ſ ǅ́"]


def test_bpe_equals_library(spark):
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN).collect()}
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode_documents(bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        want = enc.encode_ordinary(t or "")
        assert bytes(got[i].ids) == struct.pack(f"<{len(want)}I", *want) and got[i].n_tokens == len(want)
        assert back[i] == (t or "").encode()
    digest = {r.doc_id: r for r in bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, digest=True).collect()}
    assert all(digest[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(TEXTS))
    assert bpe.encode_documents(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("longest", [3, 10, 1000])
def test_safe_pieces_keep_the_text_and_its_ids(longest):
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    text = "The 'quick' brown  fox\n\n can't jump 12 34x, über den Zaun \t ok " * 20
    pieces = list(bpe.safe_pieces(text, longest))
    assert "".join(pieces) == text and len(pieces) > 1
    assert [i for p in pieces for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_chat_folds_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, "a", "message", "user", "hi ###"), (1, 1, "b", "delta", "assistant", "Hel"), (1, 3, "b", "delta", None, "lo \\"), (1, 5, "b", "regenerate", None, None), (1, 6, "b", "delta", None, "Yo"),
        (1, 7, "b", "delta", None, "!"), (1, 2, "a", "edit", None, "hey </turn>"), (2, 0, "x", "message", None, None), (2, 0, "x", "message", None, None), (None, 4, "q", None, "as:sistant", "t"),
    ]
    events = spark.createDataFrame([(*r, "extra") for r in log], "conv_id long, seq int, msg string, kind string, role string, text string, turns string")
    got = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold_events(events))).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "hey </turn>"), ("assistant", "Yo!")] and got[1].loss_text == "Yo!"
    assert [tuple(t) for t in got[2].turns] == [("", ""), ("", "")] and got[2].loss_text == ""
    assert [tuple(t) for t in got[None].turns] == [("as:sistant", "t")]
    assert chat.render(chat.fold_events(events.limit(0))).count() == 0


def test_chat_escapes_are_reversible(spark):
    rng = random.Random(5)
    parts = ["\\", "#", "###", "</turn>", " </turn>\n", "s", "h", "t", "\n", "### assistant: ", "é😀"]
    turns = [("assistant" if i % 2 else "us\\er:", "".join(rng.choices(parts, k=rng.randrange(9)))) for i in range(120)]
    events = spark.createDataFrame([(0, i, i, "message", r, t) for i, (r, t) in enumerate(turns)], "conv_id long, seq int, msg int, kind string, role string, text string")
    got = chat.read_back(chat.render(chat.fold_events(events))).first()
    assert [tuple(t) for t in got.turns] == turns
    assert got.loss_text == "".join(t for r, t in turns if r == "assistant")


def test_packing_places_each_id_once(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(1)
    texts = [*TEXTS, *(" ".join(rng.choices(["Alpha", "beta,", "ÉTÉ", "x1y2", "don't"], k=rng.randrange(900))) for _ in range(150))]
    rows = [(i, t, None if i == 3 else "hot" if i % 3 else f"s{i % 7}") for i, t in enumerate(texts)] + [(5, "again", "hot")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("length", F.lit(1))
    pieces = packing.pack(packing.tokenize(docs, path), length=256, shard_tokens=20_000, with_ids=True).collect()
    tok = packing.tokenizer(path)
    want, sequences = defaultdict(list), defaultdict(list)
    for i, t, _ in rows:
        want[i].append(tok.encode(t or "", add_special_tokens=False).ids + [1])
    have = defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length > 0 and zlib.crc32(bytes(p.ids)) == p.ids_crc32
        have[p.doc_id].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
    for i, docs_ in want.items():
        if len(docs_) == 1:
            own = sorted(have[i], key=lambda p: p.start)
            assert [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
            ids = b"".join(bytes(p.ids) for p in own)
            assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == docs_[0] and {p.doc_tokens for p in own} == {len(docs_[0])}
    assert sum(p.length for p in pieces) == sum(len(d) for ds in want.values() for d in ds)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256 and at & (at - 1) == 0
    assert packing.pack(packing.tokenize(docs.limit(0), path)).count() == 0


def test_packing_holds_the_mixture(spark):
    rows = [(i, "a" if i % 4 else "b", 300, struct.pack("<300H", *range(300))) for i in range(400)]
    tokens = spark.createDataFrame(rows, "doc_id long, source string, n long, ids binary")
    pieces = packing.pack(tokens, length=1024, shard_tokens=60_000).join(tokens.select("doc_id", "source"), "doc_id")
    by = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.sum(F.when(F.col("source") == "b", F.col("length"))).alias("b")).where("n = 1024").collect()
    assert len(by) > 100 and sum(abs((r.b or 0) / 1024 - 0.25) < 0.13 for r in by) > 0.85 * len(by)


def test_a_debt_does_not_swing_back_and_forth():
    rng, got = random.Random(1), []
    sources = ["hot", *(f"s{i}" for i in range(20))]
    docs = [(i, rng.choices(sources, [0.4] + [0.03] * 20)[0], rng.randrange(10, 1500)) for i in range(3000)]
    total = sum(n for *_, n in docs)
    share = {s: sum(n for _, t, n in docs if t == s) / total for s in sources}
    mixer = packing.Mixer(2048, lambda d, a, n, ids, seq, off: got.append((seq, docs[d][1], n)), share, {s: 2048.0 if s == "hot" else -300.0 for s in sources})
    for i, s, n in docs:
        mixer.add(i, s, struct.pack(f"<{n}H", *[7] * n))
    mixer.windows(last=True)
    hot = defaultdict(int)
    for seq, s, n in got:
        hot[seq] += n * (s == "hot")
    parts = sorted(hot[q] / 2048 for q in range(max(hot)))
    assert abs(parts[len(parts) // 10] - share["hot"]) < 0.06 and abs(parts[9 * len(parts) // 10] - share["hot"]) < 0.06


def test_arc_versions_convert_and_read_back(spark, tmp_path):
    html = ["x" * 99, "y" * 100, "y" * 100, None, "", "Ünï" * 50, "Ünï" * 50, "y" * 100, "x" * 99]
    pages = spark.createDataFrame([(i + 10, f"http://h/{i} {i}" if i else None, h, "z") for i, h in enumerate(html)], "page_id long, url string, html string, payload string")
    records = warc.convert_arcs(warc.arcs_of_pages(pages, most_bytes=600)).withColumn("key", warc.page_key())
    assert {r.version for r in records.collect()} == {"1", "2"}
    path = f"file://{tmp_path}/warc"
    warc.write_warc(warc.mark_revisits(records, "key").drop("key"), path)
    back = {r.page_id: r for r in warc.read_warc(spark, path).withColumn("page_id", warc.page_key()).collect()}
    assert len(back) == len(html)
    for i, h in enumerate(html):
        raw = (h or "").encode()
        first = next(k for k, x in enumerate(html) if (x or "").encode() == raw) + 10
        r = back[i + 10]
        assert r.payload_bytes == len(raw) and r.payload_digest == hashlib.sha256(raw).hexdigest()
        revisit = len(raw) >= 100 and first != i + 10
        assert r.record_type == ("revisit" if revisit else "response") and r.refers_to == (str(first) if revisit else None)
        assert revisit or bytes(r.payload) == raw


def test_arc_parser_on_damaged_files():
    head = b"filedesc://a 0.0.0.0 20000101000000 text/plain 14\n2 0 x\nfields\n\n"
    two = head + b"http://a b 1.2.3.4 199912312359 text/plain 200 - - 0 f 5\nhello\njunk\nhttp://c 1.2.3.4 20200101000000 t/p 404 - - 9 f 50\nshort"
    a, b = warc.parse_arc(two)
    assert (a["url"], a["content"], a["truncated"], a["status"]) == ("http://a b", b"hello", False, "200")
    assert (b["content"], b["truncated"]) == (b"short", True)
    assert warc.warc_date(a["date"]) == "1999-12-31T23:59:00Z" and warc.warc_date("?") == "1970-01-01T00:00:00Z"
    assert warc.convert(a)["type"] == "resource" and warc.convert(a | {"content": b"HTTP/1.0 200\n\nx"})["payload"] == b"x"
    assert list(warc.parse_arc(b"")) == []
    one = b"filedesc://a 0.0.0.0 20000101000000 text/plain 6\n1 0 x\nhttp://d 1.1.1.1 20000101000000 text/html 2\nok\n"
    assert [r["content"] for r in warc.parse_arc(one)] == [b"ok"]


def test_hamming_top_k_equals_brute_force(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    codes = base + [base[0]] * 40 + [b ^ (1 << rng.randrange(64)) for b in base[:20]] + [b ^ rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64) for b in base]
    signed = lambda c: c - (1 << 64) if c >> 63 else c
    rows = [(i, signed(c)) for i, c in enumerate(codes)] + [(7, signed(codes[7])), (900, None), (None, 5)]
    df = spark.createDataFrame(rows, "id long, code long").withColumn("hamming", F.lit(0))
    got = {(r.query_id, r["rank"]): (r.id, r.hamming) for r in mih.hamming_top_k(df, df.where("id % 5 = 0"), k=7).collect()}
    want = {}
    for q in range(0, len(codes), 5):
        near = sorted((bin(codes[q] ^ c).count("1"), i) for i, c in enumerate(codes) if i != q)[:7]
        want |= {(q, k + 1): (i, d) for k, (d, i) in enumerate(near)}
    assert got == want
    assert mih.hamming_top_k(df.limit(0), df.limit(0)).count() == 0
    few = spark.createDataFrame([(1, 3), (2, -1)], "id long, code long")
    assert [tuple(r) for r in mih.hamming_top_k(few, few.where("id = 1"), k=5).collect()] == [(1, 1, 2, 62)]
