"""Operator 6: mixture-controlled packing by deficit round-robin over source queues.

Every window of the sequence length is filled from the queues of all sources: with each window a source earns its
share of the window as deficit and is served when it has earned a piece. What a source is owed is carried to the
next window, from block to block within a shard, and whole from shard to shard (by prefix sums over the shards' totals).
Such a carried debt is paid, or a surplus worked off, by a part of each window, as paying it at once would starve others.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorspark.llm.common import CHUNK, LOWER, byte_values, exact_ids, hash_words, map_batches, materialize, mix, partitions, same_bytes, scan_words, slices, table, text_bytes

END_ID = 1
SHARD_TOKENS = 6_000_000
#: A shard waits in memory whole (two bytes a token) unless it is larger than this.
BLOCK_TOKENS = 16_000_000
LEAST_PIECE = 96
#: The part of its share by which a source's part of a window may differ for a carried debt.
INSTALMENT = 0.25
_MEMO = 500_000
_TOGETHER = 200


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


class WordMemo:
    """Ids of whole texts by a tokenizer that drops white space and lower-cases: each distinct word is encoded once.

    Words are cut at ASCII white space, over which no match of the tokenizer's pattern reaches, and ASCII letters
    are lowered first, as the tokenizer itself does. A full stop or comma after ASCII letters is a match of its own
    and is put aside. Words of lower-case letters alone are one match each, which ends in the only id that closes a
    word, so many of them are encoded in one call and their ids cut there.

    The memo holds sorted runs of word keys (64-bit hashes), a pool of the words themselves and one of ids, some 50
    bytes a word. A word is taken for one of the memo only if their bytes are equal; words that share a hash with another
    of the memo are encoded anew each time. It lives as long as the Python worker and is emptied when it is full.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = tokenizer(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.marks = np.zeros(256, dtype="<u2")
        for m in (".", ","):
            (self.marks[ord(m)],) = self.tokenizer.encode(m, add_special_tokens=False).ids
        self._clear()

    def _clear(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []  # sorted keys; their length, place of their bytes, place in the pool and number of ids
        self.pool, self.used, self.words = np.empty(1 << 20, dtype="<u2"), 0, 0
        self.text, self.held = np.empty(1 << 20, dtype=np.uint8), 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes], ascii_letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodes words into the pool; their places and numbers of ids."""
        plain = ascii_letters.copy()
        for k in np.flatnonzero(~plain).tolist():
            s = words[k].decode("utf-8", "replace")
            plain[k] = s.isalpha() and s == s.lower() and unicodedata.is_normalized("NFC", s)
        at, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        found: list[np.ndarray] = []
        total, rest = self.used, np.flatnonzero(~plain).tolist()
        some = np.flatnonzero(plain)
        groups = [some[i : i + _TOGETHER] for i in range(0, len(some), _TOGETHER)]
        for group, ids in zip(groups, self._encode([b" ".join([words[k] for k in g.tolist()]).decode() for g in groups]), strict=True):
            ids = np.array(ids, dtype="<u2")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(group):
                rest += group.tolist()
                continue
            number[group] = np.diff(ends, prepend=0)
            at[group] = total + ends - number[group]
            total += len(ids)
            found.append(ids)
        for i in range(0, len(rest), 20_000):
            for k, ids in zip(rest[i : i + 20_000], self._encode([words[k].decode("utf-8", "replace") for k in rest[i : i + 20_000]]), strict=True):
                at[k], number[k] = total, len(ids)
                total += len(ids)
                found.append(np.array(ids, dtype="<u2"))
        if total > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(max(total - self.used, len(self.pool)), "<u2")])
        if found:
            self.pool[self.used : total] = np.concatenate(found)
        self.used = total
        return at, number

    def _add(self, keys: np.ndarray, words: list[bytes], place: np.ndarray, number: np.ndarray) -> None:
        length = np.array([len(w) for w in words])
        stop = self.held + int(length.sum())
        if stop > len(self.text):
            self.text = np.concatenate([self.text[: self.held], np.empty(max(stop - self.held, len(self.text)), np.uint8)])
        self.text[self.held : stop] = np.frombuffer(b"".join(words), np.uint8)
        at = self.held + np.cumsum(length) - length
        self.held = stop
        order = np.argsort(keys, kind="stable")
        self.runs.append((keys[order], np.stack([length, at, place, number])[:, order]))
        self.words += len(keys)
        while len(self.runs) > 1 and len(self.runs[-2][0]) < 2 * len(self.runs[-1][0]):
            (a, x), (b, y) = self.runs[-2:]
            keys = np.concatenate([a, b])
            order = np.argsort(keys, kind="stable")
            self.runs[-2:] = [(keys[order], np.concatenate([x, y], axis=1)[:, order])]

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts, each with the end id after it, and their n + 1 offsets."""
        if self.words > _MEMO or self.used > 8 * _MEMO or self.held > 16 * _MEMO:
            self._clear()
        low = LOWER[data]
        starts, ends, bounds = scan_words(low, offsets)
        n_texts = len(offsets) - 1
        if not len(starts):
            return np.full(n_texts, end, dtype="<u2"), np.arange(n_texts + 1)
        length = ends - starts
        letters = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122), dtype=np.int32)])
        letters = letters[ends] - letters[starts]
        tail = low[ends - 1]
        marked = (length > 1) & (letters == length - 1) & ((tail == 46) | (tail == 44))
        h = hash_words(low, starts, mixed=False)
        h[marked] -= byte_values(tail[marked], length[marked] - 1)
        core = length - marked
        h = mix(h)
        inverse = exact_ids(low, starts, starts + core, h)
        at = np.empty(int(inverse.max()) + 1, np.int64)
        at[inverse[::-1]] = np.arange(len(inverse))[::-1]  # the first of each word
        keys, first, core_ = h[at], starts[at], core[at]
        place, number = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        for run, (length_, text_at, pool_at, ids_) in self.runs:
            left = np.flatnonzero(place < 0)
            i = np.minimum(np.searchsorted(run, keys[left]), len(run) - 1)
            maybe = (run[i] == keys[left]) & (length_[i] == core_[left])
            left, i = left[maybe], i[maybe]
            hit = same_bytes(low, first[left], self.text, text_at[i], core_[left])
            place[left[hit]], number[left[hit]] = pool_at[i[hit]], ids_[i[hit]]
        new = np.flatnonzero(place < 0)
        if len(new):
            raw = low.tobytes()
            words = [raw[a:b] for a, b in zip(first[new].tolist(), (first + core_)[new].tolist(), strict=True)]
            place[new], number[new] = self._learn(words, letters[at[new]] == core_[new])
            self._add(keys[new], words, place[new], number[new])
        each = number[inverse]
        count = each + marked
        begin = np.concatenate([[0], np.cumsum(count)])
        text = np.repeat(np.arange(n_texts), np.diff(bounds))
        own = begin[:-1] + text  # an end id for each text before
        out = np.empty(int(begin[-1]) + n_texts, dtype="<u2")
        within = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        out[np.repeat(own, each) + within] = self.pool[np.repeat(place[inverse], each) + within]
        out[(own + each)[marked]] = self.marks[tail[marked]]
        stops = begin[bounds[1:]] + np.arange(n_texts)
        out[stops] = end
        return out, np.concatenate([[0], stops + 1])


@lru_cache(maxsize=2)
def word_memo(path: str) -> WordMemo:
    return WordMemo(path)


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, n, ids): whole texts' ids and the end id, a row for each row of docs, null and repeated ids included.

    Null and empty texts have the end id alone, null sources are the source ''. No rows give no rows; other columns
    are not looked at.
    """
    wide = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo(path)
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for i, j in slices(offsets, CHUNK):
                ids, at = memo.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], END_ID)
                binary = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(2 * at), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(at)), binary], names=["doc_id", "source", "n", "ids"])

    return map_batches(docs.select(id_col, F.coalesce(F.col(source_col).cast("string"), F.lit("")), text_col), run, f"doc_id {wide}, source string, n long, ids binary")


class Mixer:
    """Deficit round-robin for one shard. Documents are given with add(), pieces come out of windows().

    owed: what earlier shards left owing to each source (or, negative, gave it too much); it is paid in instalments.
    """

    def __init__(self, length: int, emit: Callable, share: dict[str, float], owed: dict[str, float]) -> None:
        self.length, self.emit, self.share, self.owed = length, emit, share, owed
        self.deficit: dict[str, float] = {}
        self.queues: dict[str, deque] = {}
        self.waiting = 0
        self.sequence = 0

    def instalments(self, size: int) -> dict[str, float]:
        """What sources get beyond their shares of a window of that size, or less: as much is paid as is worked off."""
        most = {s: INSTALMENT * size * self.share.get(s, 0.0) for s in self.queues}
        pay = {s: min(max(self.owed.get(s, 0.0), -m), m) for s, m in most.items()}
        up, down = sum(x for x in pay.values() if x > 0), -sum(x for x in pay.values() if x < 0)
        both = min(up, down)
        pay = {s: x * both / (up if x > 0 else down) for s, x in pay.items() if both and x}
        for s, x in pay.items():
            self.owed[s] -= x
        return pay

    def add(self, doc_id, source: str, ids: bytes) -> None:
        self.queues.setdefault(source, deque()).append([doc_id, np.frombuffer(ids, "<u2"), 0])
        self.waiting += len(ids) // 2

    def _take(self, source: str, most: int, offset: int) -> int:
        """Serves up to most tokens of a source at offset of the present window."""
        queue, got = self.queues[source], 0
        while got < most and queue:
            doc = queue[0]
            if not doc[2]:
                doc[1] = doc[1].astype("<u4")
            n = min(most - got, len(doc[1]) - doc[2])
            self.emit(doc[0], doc[2], n, doc[1], self.sequence, offset + got)
            doc[2] += n
            got += n
            if doc[2] == len(doc[1]):
                queue.popleft()
        self.deficit[source] -= got
        self.waiting -= got
        if not queue:
            del self.queues[source]
        return got

    def windows(self, last: bool = False) -> None:
        """Fills windows until half a block waits, so that no queue runs dry before its shard ends; at the end also the
        rest, cut at powers of two: no padding."""
        size = self.length
        while self.waiting >= max(size, BLOCK_TOKENS // 2) or (last and self.waiting):
            if self.waiting < size:
                size = 1 << (self.waiting.bit_length() - 1)
            pay = self.instalments(size)
            for s in self.queues:
                self.deficit[s] = self.deficit.get(s, 0.0) + size * self.share.get(s, 0.0) + pay.get(s, 0.0)
            room = size
            for s in sorted(self.queues, key=lambda s: (-self.deficit[s], s)):
                due = int(self.deficit[s])
                if room and due >= min(LEAST_PIECE, room):
                    room -= self._take(s, min(room, due), size - room)
            while room:  # what no source has earned yet goes to those that are owed most
                s = max(self.queues, key=lambda s: (self.deficit[s], s))
                room -= self._take(s, min(room, max(LEAST_PIECE, int(self.deficit[s]))), size - room)
            self.sequence += 1


def pack(tokens: DataFrame, length: int = 2048, shares: dict[str, float] | None = None, shard_tokens: int = SHARD_TOKENS, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): pieces of sequences of exactly
    ``length`` tokens or, at a shard's end, of a smaller power of two.

    shares: wanted token proportion of each source; by default that of the whole corpus, in which all queues
    last to the end. Sources without a share are served as they are owed least. All tokens are packed whatever
    the shares. Documents are dealt to shards by a hash of id and place, so a hot source or id (null among them) spreads
    evenly; a shard is streamed in blocks of bounded size. Repeated rows are documents of their own; no rows give no pieces.
    """
    wide = dict(tokens.dtypes)["doc_id"]
    # The place is written once with the row, so that all readers see the same.
    tokens = materialize(tokens.select("doc_id", "source", "n", "ids", F.monotonically_increasing_id().alias("place")), "pack-tokens")
    total = tokens.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    dealt = tokens.withColumn("shard", F.pmod(F.xxhash64("doc_id", "place"), F.lit(shards)))
    supply = dealt.groupBy("shard", "source").agg(F.sum("n").alias("n"))
    corpus = (F.sum("n").over(Window.partitionBy("source")) / F.lit(max(total, 1))).cast("double")
    given = F.coalesce(F.element_at(F.from_json(F.lit(_json(shares or {})), "map<string,double>"), F.col("source")), F.lit(0.0))
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = supply.groupBy("shard").agg(F.sum("n").alias("all")).withColumn("earlier", F.coalesce(F.sum("all").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    wanted = supply.withColumn("wanted", corpus if shares is None else given).withColumn("had", F.coalesce(F.sum("n").over(before), F.lit(0))).join(sums, "shard")
    owed = F.col("wanted") * F.col("earlier") - F.col("had")
    state = wanted.select("shard", F.lit(0).alias("kind"), F.lit(None).cast(wide).alias("doc_id"), F.lit(-1).cast("long").alias("place"), "source", F.lit(None).cast("binary").alias("ids"), F.col("wanted").alias("share"), owed.alias("owed"))
    rows = state.unionByName(dealt.select("shard", F.lit(1).alias("kind"), "doc_id", "place", "source", "ids", F.lit(0.0).alias("share"), F.lit(0.0).alias("owed")))
    tasks = min(shards, 4 * partitions(tokens.sparkSession))
    rows = rows.repartitionById(tasks, F.col("shard").cast("int")).withColumn("deal", F.xxhash64("doc_id", "place", F.lit(7))).sortWithinPartitions("shard", "kind", "deal", "place")
    kinds = f"doc_id {wide}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, mixer = None, None

        def emit(doc_id, start, n, ids, sequence, offset):
            raw = memoryview(ids).cast("B")[4 * start : 4 * (start + n)]
            row = (doc_id, start, n, zlib.crc32(raw), len(ids), (now << 32) + sequence, offset)
            out.append((*row, bytes(raw)) if with_ids else row)

        def flushed(force: bool = False):
            while len(out) >= 20_000 or (force and out):
                some = out[:20_000]
                del out[:20_000]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=names)

        for batch in batches:
            types = [batch.schema.field(2).type, *[pa.int64()] * 6, *[pa.binary()] * with_ids]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
            for shard, kind, doc_id, source, ids, share_, owed_ in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if shard != now:
                    if mixer:
                        mixer.windows(last=True)
                        yield from flushed()
                    now, mixer = shard, Mixer(length, emit, {}, {})
                if kind == 0:
                    mixer.share[source], mixer.owed[source] = share_, owed_
                    continue
                mixer.add(doc_id, source, ids)
                if mixer.waiting >= BLOCK_TOKENS:
                    mixer.windows()
                    yield from flushed()
        if mixer:
            mixer.windows(last=True)
            yield from flushed(True)

    return map_batches(rows.select("shard", "kind", "doc_id", "source", "ids", "share", "owed"), run, kinds)


def _json(shares: dict[str, float]) -> str:
    import json

    return json.dumps(shares)


def op6_pack(spark, sf_dir: str) -> DataFrame:
    """The pieces of all documents by the corpus's own shares, without their ids; odd rows as tokenize and pack say."""
    import public_tokenizers as tokenizers

    return pack(tokenize(table(spark, sf_dir, "documents"), tokenizers.path("word_bpe_49k.json")))
