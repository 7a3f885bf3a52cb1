"""Operator 10: removal of repeated word windows by super-k-mer partitioning.

A window is k consecutive words; its minimiser is the smallest hash of its m-word runs. Consecutive windows that
share a minimiser form a super-k-mer and travel as one packed string to the minimiser's bucket: equal windows have
equal minimisers, so they meet there, where sorting finds all but the first of each exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.llm.common import exact_ids, free_name, gram_hashes, hash_words, map_batches, materialize, mix, partitions, scan_words, slices, table, text_bytes

K, M = 20, 3
_CHUNK = 4 << 20
BUCKET_BYTES = 8 << 20
#: A minimiser of at least this many super-k-mers, or of one in this many of all, is hot: at most HOT_KEYS can be.
HOT_COUNT, HOT_KEYS = 2000, 1_000_000
ONCE = 32


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, done = x, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


class Chunk:
    """The super-k-mers of consecutive texts: runs of windows [first, last) with one minimiser, by word index in the chunk."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, k: int, m: int) -> None:
        self.data, self.k = data, k
        self.starts, self.ends, self.bounds = scan_words(data, offsets)
        self.words = hash_words(data, self.starts)
        n = len(self.words)
        if n < k:
            self.first = self.last = np.zeros(0, np.int64)
            self.value = np.zeros(0, np.uint64)
            return
        grams = gram_hashes(self.words, m)
        least = sliding_min(grams, k - m + 1)
        text_of = np.searchsorted(self.bounds, np.arange(n), side="right") - 1
        valid = text_of[: n - k + 1] == text_of[k - 1 :]
        change = np.ones(len(least), dtype=bool)
        change[1:] = (least[1:] != least[:-1]) | (text_of[1 : n - k + 1] != text_of[: n - k]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(change)
        last = np.append(first[1:], len(least))
        own = valid[first]
        self.first, self.last = first[own], last[own]
        self.value, self.text = least[self.first], text_of[self.first]
        # Whether a run may hold equal windows: then their first grams are equal, closer than a run is long.
        near = np.zeros(len(least) + 1, dtype=np.int64)
        for p in range(1, min(k - m + 1, len(least))):
            near[1 : len(least) - p + 1] += grams[: len(least) - p] == grams[p : len(least)]
        near = np.cumsum(near)
        self.inner = (near[self.last] > near[self.first]) | (self.last - self.first > k - m + 1)


def later_windows(ids: np.ndarray, windows: np.ndarray, k: int) -> np.ndarray:
    """For windows (first word indexes into ids, in the order of their places): for each the position in windows of the first equal one."""
    matrix = np.lib.stride_tricks.sliding_window_view(ids, k)
    keys = gram_hashes(ids.astype(np.uint64), k)[windows]
    order = np.argsort(keys, kind="stable")
    equal = np.zeros(len(order), dtype=bool)
    equal[1:] = keys[order][1:] == keys[order][:-1]
    twins = np.flatnonzero(equal)
    for i in range(0, len(twins), 100_000):
        t = twins[i : i + 100_000]
        if not (matrix[windows[order[t]]] == matrix[windows[order[t - 1]]]).all():  # two windows share a hash
            _, at, inverse = np.unique(matrix[windows], axis=0, return_index=True, return_inverse=True)
            return at[inverse.ravel()]
    head = np.maximum.accumulate(np.where(equal, 0, np.arange(len(order))))
    out = np.empty(len(order), dtype=np.int64)
    out[order] = order[head]
    return out


# -- the packed form of super-k-mers --------------------------------------------------------------------------


#: Bytes kept of the columns of a packed group: of the minimiser three, which only say what may be equal.
_HEAD = (("<u4", 3), ("<i8", 8), ("<u4", 4), ("u1", 1))
_BREAKS = bytes.maketrans(b"\t\n\v\f\r", b"     ")


def _pack(minimiser: np.ndarray, docs: np.ndarray, place: np.ndarray, inner: np.ndarray, parts: list[bytes]) -> bytes:
    """A group of super-k-mers as one frame: the columns byte by byte (first bytes, then second ones), then the texts, which
    hold no line break, a line each."""
    import zstandard

    head = [np.array([len(parts)], "<u4").tobytes()]
    for x, (kind, width) in zip((minimiser, docs, place, inner), _HEAD, strict=True):
        head.append(np.ascontiguousarray(x.astype(kind).view("u1").reshape(len(parts), -1).T[:width]).tobytes())
    return zstandard.ZstdCompressor(level=6).compress(b"".join([*head, b"\n".join(parts)]))


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    """Minimisers (their low bytes), documents, places, repetition inside, the texts' bytes and their sizes."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, "<u4", 1)[0]), 4, []
    for kind, width in _HEAD:
        column = np.zeros((n, np.dtype(kind).itemsize), "u1")
        column[:, :width] = np.frombuffer(raw, "u1", n * width, at).reshape(width, n).T
        out.append(column.view(kind).ravel())
        at += n * width
    data = np.frombuffer(raw, np.uint8, offset=at)
    return (*out, data, np.diff(np.concatenate([[-1], np.flatnonzero(data == 10), [len(data)]])) - 1)


def _text_column(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")


def _chunks(batch: pa.RecordBatch, k: int, m: int) -> Iterator[tuple[np.ndarray, Chunk]]:
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    data, offsets = text_bytes(batch.column(1))
    for i, j in slices(offsets, _CHUNK):
        yield ids[i:j], Chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k, m)


def hot_minimisers(texts: DataFrame, k: int, m: int) -> tuple[np.ndarray, int]:
    """Minimisers of very many super-k-mers and the bytes of all super-k-mers.

    Each task reports what it met twice or more, and of what it met once every ONCE-th by a hash, for ONCE. So a
    minimiser that reaches the bound over all tasks reaches half of it in reports, however thinly it is spread; at most
    2 * HOT_KEYS can, whatever the data.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = size = 0
        task = np.uint64(TaskContext.get().partitionId())
        values, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def rows(v, c):
            c = np.where((c == 1) & (mix(v + task) % np.uint64(ONCE) == 0), ONCE, c)
            v, c = v[c > 1], c[c > 1]
            return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(c), pa.array(np.zeros(len(v), np.int64))], names=["value", "n", "size"])

        for batch in batches:
            for _, c in _chunks(batch, k, m):
                n += len(c.first)
                size += int((c.ends[c.last + k - 2] - c.starts[c.first]).sum())
                values, inverse = np.unique(np.concatenate([values, c.value]), return_inverse=True)
                counts = np.bincount(inverse, weights=np.concatenate([counts, np.ones(len(c.value), np.int64)]), minlength=len(values)).astype(np.int64)
                if len(values) > 1_000_000:
                    yield rows(values, counts)
                    values, counts = values[:0], counts[:0]
        yield rows(values, counts)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["value", "n", "size"])

    seen = materialize(map_batches(texts, run, "value long, n long, size long").groupBy("value").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).where(f"value is null or n >= {HOT_COUNT // 2}"), "sub-seen")
    total = seen.where("value is null").first()
    if total is None:
        return np.zeros(0, np.uint64), 0
    bound = max(HOT_COUNT, -(-total["n"] // HOT_KEYS)) // 2
    hot = seen.where("value is not null").where(F.col("n") >= bound).select("value").toPandas()["value"].to_numpy(np.int64)
    return np.sort(hot.view(np.uint64)), total["size"]


def repeated_spans(docs: DataFrame, k: int = K, m: int = M, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, stop): word ranges covered by windows that also start earlier (smaller id, or same id and earlier start).

    Ranges of one document may touch or overlap. Rows with a null id or text take no part. Rows that share an id are
    copies of one document to this operator: a window at the same place of both starts no earlier in either.

    Scale: super-k-mers are dealt to buckets of bounded size. A hot minimiser's windows (a passage that a third of
    the documents share, in as many contexts) go one by one to the bucket of their own content, and of equal ones
    in a chunk only the first: a bucket gets at most one a chunk.
    """
    texts = _text_column(docs, id_col, text_col)
    hot, size = hot_minimisers(texts, k, m)
    buckets = max(1, -(-size // BUCKET_BYTES))
    tasks = min(buckets, 4 * partitions(docs.sparkSession))
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for batch in batches:
            for ids, c in _chunks(batch, k, m):
                if not len(c.first):
                    continue
                raw = c.data.tobytes().translate(_BREAKS)
                out: list[tuple[int, bytes, bytes]] = []
                is_hot = np.zeros(len(c.first), dtype=bool)
                if len(hot):
                    is_hot = hot[np.minimum(np.searchsorted(hot, c.value), len(hot) - 1)] == c.value
                first, last, value, text, inner = (x[~is_hot] for x in (c.first, c.last, c.value, c.text, c.inner))
                if is_hot.any():
                    runs = c.last[is_hot] - c.first[is_hot]
                    single = np.repeat(c.first[is_hot], runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
                    of = np.repeat(c.text[is_hot], runs)
                    place = np.lexsort((single - c.bounds[of], ids[of]))
                    single, of = single[place], of[place]
                    model = later_windows(exact_ids(c.data, c.starts, c.ends, c.words), single, k)
                    where = single - c.bounds[of]
                    later = (model != np.arange(len(single))) & ((ids[of] != ids[of[model]]) | (where != where[model]))
                    spans = _merged(ids[of[later]], where[later], k)
                    if len(spans):
                        out.append((int(spans[0].sum()) % buckets, b"", spans.astype("<i8").tobytes()))
                    keep = model == np.arange(len(single))
                    single, of = single[keep], of[keep]
                    own = gram_hashes(c.words, k)[single]
                    first, last, value = np.concatenate([first, single]), np.concatenate([last, single + 1]), np.concatenate([value, own])
                    text, inner = np.concatenate([text, of]), np.concatenate([inner, np.zeros(len(single), bool)])
                begin, stop = c.starts[first], c.ends[last + k - 2]
                bucket = ((value >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order])) + 1
                for group in np.split(order, cuts):
                    if len(group):
                        parts = [raw[a:b] for a, b in zip(begin[group].tolist(), stop[group].tolist(), strict=True)]
                        low = value[group] & np.uint64(0xFFFFFFFF)
                        out.append((int(bucket[group[0]]), _pack(low, ids[text[group]], first[group] - c.bounds[text[group]], inner[group], parts), b""))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], names=["bucket", "packed", "spans"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []

        def spans_of(x: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(x[:, 2])], names=["doc_id", "start", "stop"])

        for batch in batches:
            for bucket, packed, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if spans:
                    yield spans_of(np.frombuffer(spans, "<i8").reshape(-1, 3).astype(np.int64))
                    continue
                if bucket != now and blobs:
                    yield spans_of(_later_spans(blobs, k))
                    blobs = []
                now = bucket
                blobs.append(packed)
        if blobs:
            yield spans_of(_later_spans(blobs, k))

    dealt = map_batches(texts, deal, "bucket long, packed binary, spans binary")
    return map_batches(dealt.repartitionById(tasks, F.col("bucket").cast("int")).sortWithinPartitions("bucket"), settle, "doc_id long, start long, stop long")


def _later_spans(blobs: list[bytes], k: int) -> np.ndarray:
    """(doc, start, stop) of a bucket's windows that are not the first of their kind, runs of them merged."""
    low, docs, place, inner, data, sizes = (list(x) for x in zip(*map(_unpack, blobs), strict=True))
    # What a minimiser brings alone and without repetition inside needs no look at its words.
    flat = np.concatenate(low)
    _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    wanted = (counts[inverse] > 1) | np.concatenate(inner).astype(bool)
    if not wanted.any():
        return np.zeros((0, 3), np.int64)
    pieces, at = [], 0
    for s, d in zip(sizes, data, strict=True):
        stops = np.cumsum(s + 1) - 1
        for j in np.flatnonzero(wanted[at : at + len(s)]).tolist():
            pieces.append(d[stops[j] - s[j] : stops[j]])
        at += len(s)
    docs, place = np.concatenate(docs)[wanted], np.concatenate(place)[wanted]
    order = np.lexsort((place, docs))
    docs, place = docs[order], place[order]
    pieces = [pieces[i] for i in order.tolist()]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    text = np.concatenate(pieces)
    del data, pieces, sizes, inner, low, flat, inverse, counts, wanted  # as large as what follows
    starts, ends, bounds = scan_words(text, offsets)
    ids = exact_ids(text, starts, ends, hash_words(text, starts))
    del text, starts, ends
    runs = np.diff(bounds) - k + 1
    of = np.repeat(np.arange(len(runs)), runs)
    within = np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs)
    model = later_windows(ids, bounds[of] + within, k)
    where = place[of].astype(np.int64) + within
    later = (model != np.arange(len(of))) & ((docs[of] != docs[of[model]]) | (where != where[model]))
    return _merged(docs[of[later]], where[later], k)


def _merged(docs: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """(doc, start, stop) of runs of windows that start one after the other; windows are given in the order of (doc, start)."""
    if not len(starts):
        return np.zeros((0, 3), np.int64)
    first = np.ones(len(starts), dtype=bool)
    first[1:] = (docs[1:] != docs[:-1]) | (starts[1:] > starts[:-1] + 1)
    begin = np.flatnonzero(first)
    last = np.append(begin[1:] - 1, len(starts) - 1)
    return np.stack([docs[begin], starts[begin], starts[last] + k], axis=1).astype(np.int64)


def _squeezed(rows: DataFrame, text_col: str) -> DataFrame:
    """rows with texts as zstd frames: half of what the shuffle's own compression leaves of them."""
    from pyspark.sql import types as T

    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = pa.array([None if (t := x.as_py()) is None else squeeze(t.encode()) for x in batch.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return map_batches(rows, run, T.StructType([T.StructField(f.name, T.BinaryType()) if i == at else f for i, f in enumerate(rows.schema.fields)]))


def _without(text: bytes, starts: list[int] | None, stops: list[int] | None) -> tuple[int, int, bytes]:
    """The number of a text's words, how many of them lie in the ranges, and the others joined by a space."""
    words = text.split()
    rest = words
    if starts:
        cover = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(cover, np.minimum(starts, len(words)), 1)
        np.add.at(cover, np.minimum(stops, len(words)), -1)
        rest = [w for w, c in zip(words, np.cumsum(cover)[:-1].tolist(), strict=True) if not c]
    return len(words), len(words) - len(rest), b" ".join(rest)


def remove_repeats(docs: DataFrame, k: int = K, m: int = M, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, count: str | None = "n_removed") -> DataFrame:
    """docs with repeated windows removed: (id, n_words, n_removed, kept_sha256) with digest, else all columns of docs
    with text replaced (kept words joined by a space; texts of which nothing goes stay as they are) and the number of
    words removed added under the name count, if one is given, in place of a column of that name.

    Null texts have no words and, without digest, stay null. Rows with a null id stay as they are. Repeated rows get a
    row each, treated alike: what one id's rows share starts no earlier in any of them. No rows give no rows.
    """
    spans = repeated_spans(docs, k, m, id_col, text_col)
    own, starts, stops = (free_name(docs, x) for x in ("__id", "__starts", "__stops"))
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).select(F.col("doc_id").alias(own), F.transform("spans", lambda s: s.start).alias(starts), F.transform("spans", lambda s: s.stop).alias(stops))
    rows = docs.select(F.col(id_col), F.col(text_col)) if digest else docs.drop(*[count] * (count is not None))
    rows = rows.withColumn(text_col, F.col(text_col).cast("string"))
    joined = _squeezed(rows, text_col).join(spans, F.col(id_col).cast("long") == F.col(own), "left").drop(own)
    text_at, schema = rows.columns.index(text_col), rows.schema

    def rows_of(part: pa.RecordBatch, done: list[tuple[int, int, bytes | str | None]]) -> pa.RecordBatch:
        n_words, removed, kept = zip(*done, strict=True)
        if digest:
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[id_col, "n_words", "n_removed", "kept_sha256"])
        columns = [pa.array(kept, pa.binary()).cast(pa.string()) if i == text_at else part.column(i) for i in range(part.num_columns - 2)]
        more = [] if count is None else [pa.array(removed, pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, *more], names=[*part.schema.names[:-2], *[count] * len(more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows go out once their texts reach _CHUNK bytes: a batch bounds texts as packed, which may be a thousandth of them."""
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            done, first, size = [], 0, 0
            for i, row in enumerate(zip(batch.column(text_at), batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), strict=True)):
                t, a, b = (x.as_py() for x in row)
                t = None if t is None else expand(t)
                n = gone = 0
                if t is not None and (a or digest):
                    n, gone, t = _without(t, a, b)
                done.append((n, gone, hashlib.sha256(t or b"").hexdigest() if digest else t))
                size += 0 if digest or t is None else len(t)
                if size >= _CHUNK or i + 1 == batch.num_rows:
                    yield rows_of(batch.slice(first, i + 1 - first), done)
                    done, first, size = [], i + 1, 0

    from pyspark.sql import types as T

    if digest:
        out = T.StructType([schema[id_col], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    else:
        out = T.StructType([*schema.fields, *([] if count is None else [T.StructField(count, T.LongType())])])
    return map_batches(joined, run, out)


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of all documents; odd rows as remove_repeats says."""
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS start, words FROM w WHERE len(words) >= 20),
later AS (SELECT doc_id, start FROM win QUALIFY row_number() OVER (PARTITION BY array_to_string(words[start:start + 19], ' ') ORDER BY doc_id, start) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS pos FROM later),
word AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS pos, unnest(words) AS word FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)
"""
