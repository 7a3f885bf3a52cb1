"""Operator 4: exact top-k search on binary codes by incremental multi-index hashing.

A 64-bit code is cut into m segments. If two codes differ in at most m * (r + 1) - 1 bits, some segment differs in
at most r; so once every segment has been searched to radius r, all codes up to that distance have been met. The
radius grows, for the queries still open, until the distance of the kth verified code is covered.

Segments are of 16 or 8 bits, so a radius has 12,870 masks at most. Should a query's probes at the next radius outnumber
the codes themselves, the queries still open are compared with all codes, in blocks: fewer comparisons, as exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorspark.llm.common import map_batches, materialize, partitions, table

BLOCK_CODES = 65_536


def sign_code(vec: Column) -> Column:
    """The signs of a vector's components as bits of a long, from the highest; component 64 is xored onto bit 0, and so on. Null, empty or with nulls: null."""
    x = F.aggregate(vec, F.lit(0).cast("long"), lambda acc, v: F.shiftleft(acc, 1).bitwiseOR(F.shiftrightunsigned(acc, 63)).bitwiseXOR((v > 0).cast("long")))
    return F.when(F.size(vec) > 0, x)


def segments_for(n: int) -> int:
    """The number of segments, a divisor of 64, whose length is nearest to log2 of the number of codes."""
    return min((4, 8), key=lambda m: abs(64 / m - math.log2(max(n, 2))))


def _segment(code: Column, s: int, bits: int) -> Column:
    return F.shiftrightunsigned(code, s * bits).bitwiseAND(F.lit((1 << bits) - 1))


def _probes(value: Column, low: int, high: int, bits: int) -> Column:
    """All values at distance low to high from value. Masks grow from their highest bit down: each is met once."""
    layer, out = [(0, bits)], []
    for r in range(high + 1):
        if r >= low:
            out += [m for m, _ in layer]
        layer = [(m | 1 << b, b) for m, top in layer for b in range(top)]
    masks = F.from_json(F.lit(str(out)), "array<long>")
    return F.transform(masks, lambda m: value.bitwiseXOR(m))


def hamming_top_k(codes: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", code_col: str = "code") -> DataFrame:
    """(query_id, rank, id, hamming): for each query row the k nearest rows of codes but its own id, ties to smaller ids.

    Rows with a null id or code take no part; equal rows of codes count once; all candidates if there are fewer
    than k. Equal codes are one entry that carries its k + 1 smallest ids (a rank limit that Spark applies before the
    shuffle too), which is all that any top k can need; so copies do not multiply pairs. What is open is decided by
    proof only, never by a cap. Other columns are not looked at; no rows give none. A pair is emitted at one place only: at its smallest segment distance and the first
    segment that has it.
    """
    need = k + 1
    rows = codes.where(F.col(id_col).isNotNull() & F.col(code_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(code_col).alias("code"))
    first = Window.partitionBy("code").orderBy("id")
    few = rows.distinct().withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= need)
    entries = materialize(few.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "mih-codes")
    n = entries.count()
    m = segments_for(n)
    bits = 64 // m
    asked = materialize(queries.where(F.col(id_col).isNotNull() & F.col(code_col).isNotNull()).select(F.col(id_col).alias("query_id"), F.col(code_col).alias("q")).distinct(), "mih-queries")
    index = entries.select("code", F.col("ids")[0].alias("least"), F.size("ids").alias("n"), F.posexplode(F.array(*[_segment(F.col("code"), s, bits) for s in range(m)])).alias("seg", "value"))
    open_ = asked.select("q", F.lit(64).alias("bound")).distinct()
    found: DataFrame | None = None
    answers: list[DataFrame] = []
    low, high = 0, 1
    while True:
        # open_ is a small file: without an exchange one task would make all probes.
        probes = open_.repartition(partitions(codes.sparkSession), "q").select("q", "bound", F.posexplode(F.array(*[_segment(F.col("q"), s, bits) for s in range(m)])).alias("seg", "own"))
        probes = probes.select("q", "bound", "seg", F.explode(_probes(F.col("own"), low, high, bits)).alias("value"))
        # Statistics do not see that probes multiply rows: without the hint they would be broadcast.
        met = probes.hint("merge").join(index, ["seg", "value"]).withColumn("x", F.col("q").bitwiseXOR(F.col("code")))
        gaps = F.array(*[F.bit_count(_segment(F.col("x"), s, bits)) for s in range(m)])
        met = met.where((F.array_position(gaps, F.array_min(gaps)) == F.col("seg") + 1) & (F.bit_count("x") <= F.col("bound"))).select("q", "code", "least", "n", F.bit_count("x").alias("hamming"))
        if found is not None:
            met = met.unionByName(found.join(open_, "q", "left_semi"))
        best = Window.partitionBy("q").orderBy("hamming", "least")
        found = materialize(met.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= need).drop("nth"), "mih-found")
        covered = m * (high + 1) - 1
        # How many ids are within the covered distance: if need of them, then what is not met yet is farther.
        within = found.groupBy("q").agg(F.sum(F.when(F.col("hamming") <= covered, F.col("n")).otherwise(0)).alias("within"), F.when(F.sum("n") >= need, F.max("hamming")).alias("kth"))
        if high >= bits:
            answers.append(found)
            break
        done = within.where(F.col("within") >= need).select("q")
        answers.append(found.join(done, "q", "left_semi"))
        # Codes farther than the kth met so far need not be looked at again.
        open_ = open_.join(within, "q", "left").where(F.coalesce("within", F.lit(0)) < need).select("q", F.coalesce("kth", F.lit(64)).alias("bound"))
        open_ = materialize(open_, "mih-open")
        if not open_.count():
            break
        low, high = high + 1, high + 1
        if m * math.comb(bits, high) > n:
            answers.append(materialize(_scan(open_, entries, need, n).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= need).drop("nth"), "mih-scan"))
            break
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    # One row an entry, not one an id: a query's ids are put in order within its own row.
    near = asked.join(out.select("q", "code", "hamming"), "q").join(entries, "code").groupBy("query_id").agg(F.collect_list(F.struct("hamming", "ids")).alias("near"))
    pairs = F.flatten(F.transform("near", lambda e: F.transform(e.ids, lambda i: F.struct(e.hamming.alias("hamming"), i.alias("id")))))
    first_k = F.slice(F.sort_array(F.filter(pairs, lambda x: x.id != F.col("query_id"))), 1, k)
    return near.select("query_id", F.posexplode(first_k).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.id", "x.hamming")


def _scan(open_: DataFrame, entries: DataFrame, need: int, n: int) -> DataFrame:
    """(q, code, least, n, hamming): for each open query the need nearest codes of each block of all codes."""
    blocks = -(-n // BLOCK_CODES)
    rows = entries.select(F.pmod(F.xxhash64("code"), F.lit(blocks)).alias("block"), F.lit(0).alias("kind"), "code", F.col("ids")[0].cast("long").alias("least"), F.size("ids").alias("n"))
    asked = open_.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("kind"), F.col("q").alias("code"), F.lit(0).cast("long").alias("least"), F.lit(0).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, code, least, copies = None, [], None, None, None
        for batch in batches:
            block, kind = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                if block[a] != now:
                    now, held, code = block[a], [], None
                part = [batch.column(k).slice(a, b - a).to_numpy(zero_copy_only=False) for k in (2, 3, 4)]
                if kind[a] == 0:
                    held.append(part)
                    continue
                if code is None and held:
                    code, least, copies = (np.concatenate(x) for x in zip(*held, strict=True))
                if code is None:
                    continue
                out = []
                for q in part[0].tolist():
                    far = far_of(code, q)
                    kth = np.partition(far, min(need, len(far)) - 1)[min(need, len(far)) - 1]
                    some = np.flatnonzero(far <= kth)
                    some = some[np.lexsort((least[some], far[some]))[:need]]
                    out.append((np.full(len(some), q), code[some], least[some], copies[some], far[some].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["q", "code", "least", "n", "hamming"])

    dealt = rows.unionByName(asked).repartition("block").sortWithinPartitions("block", "kind")
    return map_batches(dealt, run, "q long, code long, least long, n int, hamming int")


def far_of(codes: np.ndarray, q: int) -> np.ndarray:
    """Hamming distances of codes, as signed 64-bit integers, from q."""
    return np.bitwise_count((codes ^ np.int64(q)).view(np.uint64))


def op4_hamming_top_k(spark, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, hamming): the 10 nearest sign codes of each vector whose id is divisible by 20; odd rows as hamming_top_k says."""
    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    out = hamming_top_k(codes, codes.where(F.col("id") % 20 == 0), k=10)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("hamming").cast("int").alias("hamming"))


ORACLE = """
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x > 0 AS INTEGER)) AS b FROM embeddings WHERE len(embedding) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.b, c.b), lambda z: CASE WHEN z[1] = z[2] THEN 0 ELSE 1 END)) AS INTEGER) AS hamming
  FROM s q JOIN s c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hamming, vec_id) AS INTEGER) AS rank, vec_id, hamming
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hamming, vec_id) <= 10
"""
