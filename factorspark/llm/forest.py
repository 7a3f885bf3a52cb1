"""Operator 1: approximate nearest neighbours by a hash-prefix forest.

Every vector has a pool of sign bits of random projections; each tree's hash string is a choice of 32 of them in an order
of its own. A tree is the sorted array of all rows' strings, cut into ranges by their first bits where it is large.
A query's own strings, made once, descend to their longest matching prefixes in all trees; the trees tell how many rows
each shorter prefix adds, and from these numbers all trees ascend together, level by level, until the query has enough
candidates. The last level is shared out between the trees. Candidates are compared exactly.

A prefix's rows are an index of ids alone; vectors wait in blocks of bounded size and candidates come to them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorspark.llm.common import map_batches, materialize, mix, table

TREES, BITS, POOL = 128, 32, 1024
#: Rows of a range of a tree, after which one more leading bit is cut off; a range of four times as many is dealt to several tasks.
RANGE_ROWS = 1 << 18
BLOCK_ROWS = 8192


def wanted_rows(n: int, k: int) -> int:
    """Rows to collect among n vectors for k neighbours; a row, the query's own too, counts once for each tree that gives it.

    The power of n is for vectors without any cluster structure, the hardest case for hashing, measured (README) for
    recall above 0.9. Small tables are collected whole.
    """
    return max(TREES * min(n, 8 * (k + 1)), TREES + math.ceil(3.5 * n**0.8))


def planes(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The pool's projections and each tree's choice of its bits."""
    rng = np.random.default_rng(4242 + dim)
    return rng.standard_normal((dim, POOL)), np.stack([rng.permutation(POOL)[:BITS] for _ in range(TREES)])


def hash_strings(vectors: np.ndarray) -> np.ndarray:
    """(TREES, n) strings of BITS signs as uint32, first bit highest."""
    projections, choice = planes(vectors.shape[1])
    out = np.empty((TREES, len(vectors)), dtype=np.uint32)
    for i in range(0, len(vectors), 512):
        signs = vectors[i : i + 512] @ projections > 0
        for t in range(TREES):
            out[t, i : i + 512] = np.ascontiguousarray(np.packbits(signs[:, choice[t]], axis=1)).view(">u4").ravel()
    return out


class Measured:
    """Vectors ready for cosines, by component, with their norms. Each is first multiplied by a power of two, which changes no
    cosine and keeps squares finite."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.by_component = np.ascontiguousarray(np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None]).T)
        total = np.zeros(len(vectors))
        for c in self.by_component:
            total += c * c
        self.norms = np.sqrt(total)


def cosines(rows: Measured, queries: Measured, of_row: np.ndarray, of_query: np.ndarray) -> np.ndarray:
    """The cosine of each pair in double precision, summed in the order of components: a pair's score is the same anywhere."""
    dot = np.zeros(len(of_row))
    for r, q in zip(rows.by_component, queries.by_component, strict=True):
        dot += r[of_row] * q[of_query]
    return dot / (rows.norms[of_row] * queries.norms[of_query])


def matches(keys: np.ndarray, strings: np.ndarray, length) -> tuple[np.ndarray, np.ndarray]:
    """For each string the range of sorted keys that share its first length bits; one length, or one for each."""
    shift = (BITS - np.asarray(length)).astype(np.uint64)
    low = (strings.astype(np.uint64) >> shift) << shift
    return np.searchsorted(keys, low), np.searchsorted(keys, low + (np.uint64(1) << shift))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


def _trees(rows: DataFrame, cut: dict[int, int], kind: int) -> DataFrame:
    """(dim, tree, range, kind, n, ids, strings, stops): rows of (dim, id, v[, stop, deeper, level]) packed by tree and range."""
    more = [c for c in ("stop", "deeper", "level") if c in rows.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(0).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                own = batch.take(pa.array(np.flatnonzero(dims == dim)))
                ids, strings = own.column(1).to_numpy(zero_copy_only=False).astype("<i8"), hash_strings(_vectors(own.column(2), dim))
                stops = np.stack([own.column(k).to_numpy(zero_copy_only=False) for k in range(3, 6)], axis=1).astype("<i8") if more else np.zeros((len(ids), 0), "<i8")
                out = []
                for t in range(TREES):
                    part = strings[t].astype(np.uint64) >> np.uint64(BITS - cut[dim])
                    order = np.argsort(part, kind="stable")
                    for group in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                        out.append((dim, t, int(part[group[0]]), kind, len(group), ids[group].tobytes(), strings[t, group].astype("<u4").tobytes(), stops[group].tobytes()))
                types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 3]
                yield _batch("dim tree range kind n ids strings stops", *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)))

    return map_batches(rows.select("dim", "id", "v", *more), run, "dim int, tree int, range long, kind int, n long, ids binary, strings binary, stops binary")


def _in_trees(index: DataFrame, asked: DataFrame, visit, schema: str) -> DataFrame:
    """What visit(keys, ids, first bits, query ids, query strings, query stops) yields for each range of each tree with queries in it.

    A range of too many rows is dealt to several tasks, each with all its queries.
    """
    place = ["dim", "tree", "range"]
    sizes = index.groupBy(*place).agg(F.ceil(F.sum("n") / (4 * RANGE_ROWS)).cast("int").alias("parts")).where("parts > 1")
    if sizes.take(1):
        sizes = materialize(sizes, "forest-hot")
        index = index.join(sizes, place, "left").withColumn("part", F.pmod(F.xxhash64("ids"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        asked = asked.join(sizes, place, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    else:
        index, asked = (x.withColumn("part", F.lit(0)) for x in (index, asked))
    place.append("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, asking = None, [], []

        def done():
            if held and asking:
                ids, strings = (np.concatenate([np.frombuffer(x[k], kind) for x in held]) for k, kind in ((0, "<i8"), (1, "<u4")))
                order = np.lexsort((ids, strings))
                q, s = (np.concatenate([np.frombuffer(x[k], kind) for x in asking]) for k, kind in ((0, "<i8"), (1, "<u4")))
                stops = np.concatenate([np.frombuffer(x[2], "<i8") for x in asking]).reshape(len(q), -1)
                yield from visit(strings[order].astype(np.uint64), ids[order], now[0], q, s, stops)

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(8)]
            for dim, tree, part_of, part, kind, ids, strings, stops in zip(*columns, strict=True):
                if (dim, tree, part_of, part) != now:
                    yield from done()
                    now, held, asking = (dim, tree, part_of, part), [], []
                (asking if kind else held).append((ids, strings, stops))
        yield from done()

    both = index.unionByName(asked).select(*place, "kind", "ids", "strings", "stops")
    return map_batches(both.repartition(*place).sortWithinPartitions(*place, "kind"), run, schema)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, wanted: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each query the k nearest of the candidates found, by cosine in double precision.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids; vectors
    of another length than a query's are not its candidates. Repeated rows with one id count once, with the smallest
    of their vectors. All candidates if there are fewer than k; no rows give no rows. Equal vectors are one entry that
    carries its k + 1 smallest ids, all that any top k can need, and score alike, so ties go to smaller ids. Other
    columns are not looked at.

    wanted: the rows to collect for a query before trees stop ascending, wanted_rows of their number by default.
    """

    def usable(df: DataFrame) -> DataFrame:
        v = F.transform(vec_col, lambda x: x.cast("double"))
        df = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and size(v) > 0")
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.where(finite & F.exists("v", lambda x: x != 0)).groupBy("id").agg(F.min("v").alias("v"))

    copy = Window.partitionBy("v").orderBy("id")
    few = usable(rows).withColumn("nth", F.row_number().over(copy)).where(F.col("nth") <= k + 1)
    entries = materialize(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.size("v").alias("dim"), F.col("ids")[0].alias("id"), "v", "ids"), "forest-entries")
    sizes = {r["dim"]: r["n"] for r in entries.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one number for each length that occurs
    if not sizes:
        return entries.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), "id", F.lit(0.0).alias("score")).where("false")
    most = {dim: wanted or wanted_rows(n, k) for dim, n in sizes.items()}
    cut = {dim: max(0, math.ceil(math.log2(n / RANGE_ROWS))) for dim, n in sizes.items()}
    blocks = {dim: -(-n // BLOCK_ROWS) for dim, n in sizes.items()}
    asked = materialize(usable(queries).select(F.size("v").alias("dim"), "id", "v").where(F.col("dim").isin(list(sizes))), "forest-queries")
    index = materialize(_trees(entries, cut, 0), "forest-index")

    def descend(keys, ids, dim, q, strings, _):
        """How many rows each prefix adds to those of the longer ones; not beyond what the query wants."""
        found, left = np.zeros(len(q), np.int64), np.arange(len(q))
        out = []
        for length in range(BITS, cut[dim] - 1, -1):
            low, high = matches(keys, strings[left], length)
            more = high - low - found[left]
            some = more > 0
            out.append((q[left[some]], np.full(int(some.sum()), length, np.int32), more[some]))
            found[left] = high - low
            left = left[found[left] < most[dim]]
            if not len(left):
                break
        yield _batch("id level n", *(np.concatenate(x) for x in zip(*out, strict=True)))

    added = _in_trees(index, _trees(asked, cut, 1), descend, "id long, level int, n long").groupBy("id", "level").agg(F.sum("n").alias("n"))
    down = Window.partitionBy("id").orderBy(F.desc("level"))
    added = added.join(asked.select("id", "dim"), "id").withColumn("upto", F.sum("n").over(down))
    need = F.element_at(F.create_map(*[F.lit(x) for pair in most.items() for x in pair]), F.col("dim"))
    # The level at which a query has enough, or the last: what deeper levels hold, and what it holds itself.
    reached = F.struct(F.when(F.col("upto") >= need, F.col("level")).otherwise(F.lit(-1)).alias("stop"), (F.col("upto") - F.col("n")).alias("deeper"), F.col("n").alias("level"))
    ends = added.groupBy("id").agg(F.max(reached).alias("end"), F.min(F.struct("level", (F.col("upto") - F.col("n")).alias("deeper"), F.col("n").alias("n"))).alias("last"))
    enough = F.col("end.stop") >= 0
    stops = materialize(ends.select("id", F.when(enough, F.col("end.stop")).otherwise(F.col("last.level")).alias("stop"), F.when(enough, F.col("end.deeper")).otherwise(F.col("last.deeper")).alias("deeper"), F.when(enough, F.col("end.level")).otherwise(F.col("last.n")).alias("level")), "forest-stops")

    def ascend(keys, ids, dim, q, strings, stops):
        """The ids under each query's deeper prefixes and this tree's part of its last level, evenly spaced."""
        stop, deeper, level = stops.T
        low, high = matches(keys, strings, stop)
        a, b = matches(keys, strings, np.minimum(stop + 1, BITS))
        b = np.where(stop < BITS, b, a)  # nothing is deeper than whole strings
        rest = (a - low) + (high - b)
        part = np.minimum(rest, -(-rest * np.maximum(most[dim] - deeper, 0) // np.maximum(level, 1)))
        for i in range(0, len(q), 4096):
            got = []
            for a_, b_, low_, rest_, part_ in zip(*(x[i : i + 4096].tolist() for x in (a, b, low, rest, part)), strict=True):
                at = low_ + np.arange(part_) * rest_ // max(part_, 1)
                got.append(np.concatenate([ids[a_:b_], ids[np.where(at >= a_, at + (b_ - a_), at)]]).astype("<i8").tobytes())
            yield _batch("id ids", q[i : i + 4096], pa.array(got, pa.binary()))

    met = _in_trees(index, _trees(asked.join(stops, "id"), cut, 1), ascend, "id long, ids binary").groupBy("id").agg(F.collect_list("ids").alias("met"))

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query's distinct candidates, to the blocks that hold their vectors."""
        for batch in batches:
            for dim, q, v, lists in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                ids = np.unique(np.frombuffer(b"".join(lists), "<i8"))
                block = _block(ids, blocks[dim])
                order = np.argsort(block, kind="stable")
                groups = np.split(order, np.flatnonzero(np.diff(block[order])) + 1)
                n = len(groups)
                yield _batch("dim block kind id v ids", pa.array([dim] * n, pa.int32()), np.array([block[g[0]] for g in groups], np.int64), pa.array([1] * n, pa.int32()), pa.array([q] * n, pa.int64()), pa.array([v] * n, pa.list_(pa.float64())), pa.array([ids[g].astype("<i8").tobytes() for g in groups], pa.binary()))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 0))
            block = _block(ids, np.array([blocks[d] for d in dims.tolist()], np.int64))
            yield _batch("dim block kind id v ids", batch.column(0), block, pa.array([0] * len(ids), pa.int32()), batch.column(1), batch.column(2), pa.array([None] * len(ids), pa.binary()))

    kinds = "dim int, block long, kind int, id long, v array<double>, ids binary"
    there = map_batches(entries.select("dim", "id", "v"), placed, kinds)
    here = map_batches(asked.join(met, "id").select("dim", "id", "v", "met"), to_blocks, kinds)
    dealt = there.unionByName(here).repartition("dim", "block").sortWithinPartitions("dim", "block", "kind", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ids, vectors = None, [], None, None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                dim, block, kind = key[:, a].tolist()
                if (dim, block) != now:
                    now, held, ids = (dim, block), [], None
                part = batch.slice(a, b - a)
                own, v = part.column(3).to_numpy(zero_copy_only=False), _vectors(part.column(4), dim)
                if kind == 0:
                    held.append((own, v))
                    continue
                if ids is None:
                    ids, vectors = np.concatenate([x[0] for x in held]), Measured(np.concatenate([x[1] for x in held]))
                for i in range(0, len(own), 32):
                    yield _best(ids, vectors, own[i : i + 32], Measured(v[i : i + 32]), [np.frombuffer(x.as_py(), "<i8") for x in part.column(5).slice(i, 32)], k + 1)

    scores = map_batches(dealt, compare, "query_id long, entry long, score double")
    # Of each block's best, a query's best k + 1 entries, one of which may be its own, hold all its answers.
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry")
    top = scores.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    near = top.join(entries.select(F.col("id").alias("entry"), "ids"), "entry").groupBy("query_id").agg(F.collect_list(F.struct("score", "ids")).alias("near"))
    pairs = F.flatten(F.transform("near", lambda e: F.transform(e.ids, lambda i: F.struct((-e.score).alias("far"), i.alias("id")))))
    first = F.slice(F.sort_array(F.filter(pairs, lambda x: x.id != F.col("query_id"))), 1, k)
    return near.select("query_id", F.posexplode(first).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.id", (-F.col("x.far")).alias("score"))


def _block(ids: np.ndarray, blocks) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.asarray(blocks, dtype=np.uint64)).astype(np.int64)


def _best(ids: np.ndarray, vectors: Measured, queries: np.ndarray, wanted: Measured, candidates: list[np.ndarray], k: int) -> pa.RecordBatch:
    """The k best candidates of each query in this block, ties to smaller ids; ids are sorted."""
    of_row = np.searchsorted(ids, np.concatenate(candidates))
    sizes = [len(c) for c in candidates]
    scores, at, out = cosines(vectors, wanted, of_row, np.repeat(np.arange(len(queries)), sizes)), 0, []
    for q, n in zip(queries.tolist(), sizes, strict=True):
        s, r = scores[at : at + n], of_row[at : at + n]
        if n > k:
            near = np.flatnonzero(s >= np.partition(s, n - k)[n - k])
            s, r = s[near], r[near]
        order = np.lexsort((ids[r], -s))[:k]
        out.append((np.full(len(order), q), ids[r[order]], s[order]))
        at += n
    return _batch("query_id entry score", *(np.concatenate(x) for x in zip(*out, strict=True)))


def op1_forest(spark, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the 5 nearest vectors found of each whose id is divisible by 50; odd rows as nearest says."""
    vectors = table(spark, sf_dir, "embeddings")
    out = nearest(vectors, vectors.where("vec_id % 50 = 0"))
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
