"""What the operators of this subpackage share: tables, the shared folder, word scanning and components.

Intermediate results that are read more than once are written as Parquet into the folder that the
session names in ``spark.checkpoint.dir`` (:func:`materialize`), so that a lost executor costs a
re-read of a file and not a recomputation of the whole lineage. What a query wrote on its way goes
once its result is written (:func:`settled`).
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that a task decodes at once from Parquet: texts may have 100 KB and more each. Bytes that it holds of a row group it writes.
READ_ROWS, GROUP_BYTES = 256, 16 << 20


def bounded(spark: SparkSession) -> None:
    """Bounds what a task's JVM holds of texts while it reads and writes Parquet, by session settings, which stay; smaller ones are kept.

    Row groups are read into the heap and not by vectored reads, whose direct buffers come on top of it, as large as the
    heap once more, and go only when garbage happens to be collected.
    """
    conf, block = spark.conf, "parquet.block.size"
    if int(conf.get(rows := "spark.sql.parquet.columnarReaderBatchSize")) > READ_ROWS:
        conf.set(rows, str(READ_ROWS))
    if int(conf.get(block, None) or spark.sparkContext._jsc.hadoopConfiguration().getLong(block, 128 << 20)) > GROUP_BYTES:
        conf.set(block, str(GROUP_BYTES))
    conf.set("parquet.hadoop.vectored.io.enabled", "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, one beside the warehouse's tables; only
    with all executors in this process may it be a temporary folder of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        alone = spark.sparkContext.master.split("[")[0] == "local"
        named = f"file://{tempfile.mkdtemp(prefix='factorspark-')}" if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/factorspark-work"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    bounded(spark)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: The tables that this process has written to the shared folder and not removed.
WRITTEN: list[str] = []


def remove_written(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Removes the tables written after the first ``since``, but for the last ``keep``: for when nothing is read from them any more."""
    jvm = spark.sparkContext._jvm
    for name in WRITTEN[since : len(WRITTEN) - keep]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del WRITTEN[since : len(WRITTEN) - keep]


def settled(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query whose result is written once; all that it wrote on its way is then removed."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        before = len(WRITTEN)
        out = materialize(query(spark, sf_dir), query.__name__)
        remove_written(spark, before, keep=1)
        return out

    return run


#: Bytes of a batch that a Python worker gets at once, if the session doesn't name fewer.
BATCH_BYTES = 8 << 20
#: Bytes of texts that are worked on at once: temporary arrays are some forty times as large.
CHUNK = 1 << 20


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with batches of bounded bytes (rows alone don't bound texts), in workers that give their memory back.

    The bound is a session setting, which stays. Workers are used again and again: what the allocators keep of one
    task would add up over workers, so it goes back to the system when the task ends.
    """
    bounded(df.sparkSession)
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(df.sparkSession._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(lean, schema)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as make it none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def columns_of(df: DataFrame, names: list[str]) -> DataFrame:
    """df with these columns only, whatever characters their names hold."""
    return df.select(*[F.col("`" + n.replace("`", "``") + "`") for n in names])


def labelled_sample(docs: DataFrame, labels: DataFrame, mark: str, rows: int) -> DataFrame:
    """(doc_id, mark, text): the labelled documents with the smallest id hashes, rows at most, crc32(id) mod 5 not 0.

    Of several texts with one id the smallest counts, of several marks the largest, so that the same tables give the same
    sample. Null ids and marks take no part.
    """
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    marks = labels.where(F.col(mark).isNotNull() & F.col("doc_id").isNotNull() & ~held).groupBy("doc_id").agg(F.max(mark).cast("int").alias("mark"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    first = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return texts.join(F.broadcast(first), "doc_id").groupBy("doc_id", "mark").agg(F.min("text").alias("text"))


def give_back() -> None:
    """Returns free memory of this process to the system, where its C library can."""
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------------------------------------
# Words: maximal runs of bytes other than space, \t, \n, \v, \f, \r. None of these bytes occurs
# inside a multi-byte UTF-8 character, so scanning bytes equals scanning characters.
# ---------------------------------------------------------------------------------------------

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A random 64-bit value for each byte at each of the first places of a word; white space counts as nothing.
PLACES = 64
BYTE_VALUE = np.random.default_rng(20240229).integers(0, 2**64, (PLACES, 256), dtype=np.uint64)
BYTE_VALUE[:, SPACE] = 0
_SLAB = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(offsets: np.ndarray, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most most_bytes together, or one longer row alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def scan_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of all words of consecutive texts, and n + 1 word offsets of the texts."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    word = ~SPACE[data]
    edge = np.zeros(len(data), dtype=bool)  # a text starts here, so that a word cannot run over it
    inner = offsets[:-1][offsets[:-1] < len(data)]
    edge[inner] = True
    before = np.empty(len(data), dtype=bool)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | edge))
    after_edge = np.empty(len(data), dtype=bool)
    after_edge[:-1], after_edge[-1] = ~word[1:] | edge[1:], True
    ends = np.flatnonzero(word & after_edge) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def byte_values(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """What bytes at these places of a word add to its hash: table values, mixed with the round beyond the table's places."""
    out = BYTE_VALUE.ravel()[((places & (PLACES - 1)) << 8) | data]
    far = np.flatnonzero(places >= PLACES)
    if len(far):
        rounds = (places[far] // PLACES).astype(np.uint64)
        out[far] = np.where(out[far] == 0, np.uint64(0), mix(out[far] + rounds * np.uint64(0x9E3779B97F4A7C15)))
    return out


def hash_words(data: np.ndarray, starts: np.ndarray, mixed: bool = True) -> np.ndarray:
    """A 64-bit value for each word, equal for equal words; white space after a word doesn't count.

    Not mixed, it is the sum of byte_values. Different words can share a value: where equality must be
    certain, :func:`exact_ids` compares the words themselves.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _SLAB, side="left")))
        a, b = int(starts[i]), int(starts[j]) if j < n else len(data)
        own = (starts[i:j] - a).astype(np.int64)
        within = np.arange(b - a) - np.repeat(own, np.diff(np.append(own, b - a)))
        out[i:j] = np.add.reduceat(byte_values(data[a:b], within), own)
        i = j
    return mix(out) if mixed else out


def same_bytes(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each pair of words of one length, none empty, whether their bytes are equal."""
    out = np.ones(len(lengths), dtype=bool)
    for i in range(0, len(lengths), 1 << 15):
        own = lengths[i : i + (1 << 15)]
        first = np.cumsum(own) - own
        within = np.arange(int(own.sum())) - np.repeat(first, own)
        differ = a[np.repeat(a_starts[i : i + (1 << 15)], own) + within] != b[np.repeat(b_starts[i : i + (1 << 15)], own) + within]
        out[i : i + (1 << 15)] = ~np.logical_or.reduceat(differ, first)
    return out


def exact_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for each word, equal exactly for equal words: hashes, proven by comparing each word with its hash's first.

    Should two words share a hash, all are numbered by their bytes instead.
    """
    _, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    lengths, model = ends - starts, at[inverse]
    if (lengths == lengths[model]).all() and same_bytes(data, starts, data, starts[model], lengths).all():
        return inverse.astype(np.int64)
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(data[a:b].tobytes(), len(known)) for a, b in zip(starts, ends, strict=True)], dtype=np.int64)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit values of all runs of n consecutive words (positions where a text ends inside are for the caller to drop)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k])
    return h


# ---------------------------------------------------------------------------------------------
# Connected components by alternating large-star and small-star steps, all in DataFrames.
# ---------------------------------------------------------------------------------------------


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over undirected edges (u, v), u != v. Hot nodes: the minima are partial aggregates and the
    join back is a plain sort-merge join whose skewed side adaptive execution may split."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-min")
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


#: Up to this many edges (16 MB) a single executor task finds the components; beyond it, rounds of star steps do.
TASK_EDGES = 1_000_000


def _components_in_task(edges: DataFrame) -> DataFrame:
    kind = dict(edges.dtypes)["u"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0), b.column(1)) for b in batches if b.num_rows]
        if not got:
            return
        type_ = got[0][0].type
        u, v = (np.concatenate([g[k].to_numpy(zero_copy_only=False) for g in got]) for k in (0, 1))
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = np.split(at, 2)
        label = np.arange(len(ids))
        while True:
            least = np.minimum(label[a], label[b])
            after = label.copy()
            np.minimum.at(after, label[a], least)
            np.minimum.at(after, label[b], least)
            while (after[after] != after).any():
                after = after[after]
            if (after == label).all():
                break
            label = after
        for i in range(0, len(ids), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 100_000], type_), pa.array(ids[label[i : i + 100_000]], type_)], names=["id", "component"])

    return map_batches(edges.select("u", "v").coalesce(1), run, f"id {kind}, component {kind}")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of edges (u, v): component is the smallest id reachable.

    Null ends and loops link nothing. Many edges are worked on in rounds, each written to the shared folder, until
    a round leaves them as they were (every edge then points from a node to its component's smallest id); what fits
    in a task of bounded size is one task's work.
    """
    now = materialize(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    if now.count() <= TASK_EDGES:
        return materialize(_components_in_task(now), "cc-done")
    sums = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = sums(now)
    if seen[0]:
        for _ in range(most_rounds):
            now = materialize(_star(materialize(_star(now, True), "cc-large"), False), "cc")
            if (got := sums(now)) == seen:
                break
            seen = got
        else:
            raise RuntimeError(f"components: no fixed point after {most_rounds} rounds")
    ids = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
