"""Operator 5: near-duplicate components by HyperMinHash.

Each document's set of word shingles becomes a sketch of 128 buckets. A bucket keeps of its smallest hash the number
of leading zeros (6 bits) and the 10 bits after the leading one: 16 bits instead of 64. Bands of four buckets
find candidates, a Jaccard estimate corrected for the accidental collisions of such short registers screens pairs
(with a margin of more than five standard deviations), and full sets confirm every link: sets of shingles of the
words themselves, numbered by their bytes and not by their hashes.

A bucket here has a hash of its own instead of a share of one hash's range: sets with fewer shingles than buckets
would otherwise leave most buckets empty. With 32 bands of 4, a pair of Jaccard 0.8 is missed with probability 5e-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.llm.common import CHUNK, LOWER, SPACE, components, exact_ids, gram_hashes, hash_words, map_batches, materialize, scan_words, slices, table, text_bytes

BUCKETS, BAND = 128, 4
MANTISSA_BITS = 10
MARGIN = 0.2
BLOCK_ROWS, BLOCK_BYTES = 128, 8 << 20
#: A component of more blocks is compared across them in so many groups of blocks, or as many as BLOCK_BYTES asks for.
GROUPS = 32
_rng = np.random.default_rng(77)
_A = _rng.integers(0, 2**63, BUCKETS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, BUCKETS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, int, bytes]]:
    """For each text its distinct n-word shingles as sorted 64-bit hashes, A-Z lowered, their exact number, and a digest of
    its lowered words. A text of fewer words is one shingle, one without words none.

    Equal shingles have equal hashes; where a text has fewer hashes than shingles, those that share one are compared.
    """
    for i, j in slices(offsets, CHUNK):
        low, at = LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        starts, ends, bounds = scan_words(low, at)
        hashes = hash_words(low, starts)
        ids, grams = exact_ids(low, starts, ends, hashes), gram_hashes(hashes, n)
        # The words with one space after each: white space goes, but for the byte after a word.
        keep, plain = ~SPACE[low], low.copy()
        after = ends[ends < len(low)]
        after = after[~keep[after]]
        keep[after], plain[after] = True, 0x20
        plain, place = plain[keep].tobytes(), np.concatenate([[0], np.cumsum(keep)])[at].tolist()
        for t, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            own = grams[a : b - n + 1] if b - a >= n else gram_hashes(hashes[a:b], b - a) if b > a else grams[:0]
            found = np.unique(own)
            size = len(found) if len(found) == len(own) else _distinct(own, ids[a:b], n)
            yield found, size, hashlib.blake2b(plain[place[t] : place[t + 1]].strip(b" "), digest_size=16).digest()


def _distinct(grams: np.ndarray, ids: np.ndarray, n: int) -> int:
    """The number of different windows of n ids; grams are their hashes."""
    order = np.argsort(grams, kind="stable")
    twin = np.flatnonzero(grams[order[1:]] == grams[order[:-1]])
    a, b = order[twin], order[twin + 1]
    if all((ids[a + k] == ids[b + k]).all() for k in range(n)):
        return len(grams) - len(twin)
    return len(np.unique(np.lib.stride_tricks.sliding_window_view(ids, n), axis=0))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The smallest hash of each bucket; the set must not be empty."""
    least = np.full(BUCKETS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[i : i + 2048][None, :] * _A[:, None] + _B[:, None]).min(axis=1), out=least)
    return least


def registers(least: np.ndarray) -> np.ndarray:
    """Leading zeros (at most 53 counted) and mantissa of smallest hashes, as uint16."""
    top = np.frexp((least >> np.uint64(11)).astype(np.float64))[1].astype(np.uint64)
    zeros = np.uint64(53) - top
    mantissa = (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA_BITS)
    return ((zeros << np.uint64(MANTISSA_BITS)) | mantissa).astype(np.uint16)


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard from the number of equal registers of sets of n and m shingles, less what collides by accident."""
    ratio = n / np.maximum(m, 1)
    by_chance = 0.169919 * 2.0 ** (1 - MANTISSA_BITS) * 4 * ratio / (1 + ratio) ** 2  # the paper's constant for large sets
    return (equal / BUCKETS - by_chance) / (1 - by_chance)


def sketches(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, check, size, n, fp0, fp1, bands): a hash of the text that tells rows of one id apart, the text's bytes, the set's
    size, a 128-bit digest of the lowered words and the registers, four to a long."""
    wide = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, least = [], [], []
            data, offsets = text_bytes(batch.column(1))
            for s, size, digest in shingle_sets(data, offsets, n):
                sizes.append(size)
                digests.append(digest)
                least.append(sketch(s) if len(s) else np.zeros(BUCKETS, np.uint64))
            if not sizes:
                continue
            bands = registers(np.stack(least)).view("<u8").astype(np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * bands.shape[1], pa.int32()), pa.array(bands.ravel()))
            fp = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(offsets)), pa.array(sizes, pa.int64()), pa.array(fp[:, 0].copy()), pa.array(fp[:, 1].copy()), flat], names=["doc_id", "check", "size", "n", "fp0", "fp1", "bands"])

    return map_batches(docs.select(id_col, text_col, F.xxhash64(text_col)), run, f"doc_id {wide}, check long, size long, n long, fp0 long, fp1 long, bands array<long>")


class Block:
    """Texts that are compared with one another: links are found by pivots, until each pair is either joined or refuted."""

    def __init__(self, ids: list, texts: list[bytes], regs: np.ndarray, percent: int, n: int) -> None:
        self.ids, self.percent, self.regs = ids, percent, regs
        self.flat, self.n = exact_shingles(texts, n)
        self.size = int(self.flat.max()) + 1 if len(self.flat) else 0
        df = np.bincount(self.flat, minlength=self.size)
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        #: Shingles of each set that another set of the block has too: no intersection is larger.
        self.shared = np.diff(np.concatenate([[0], np.cumsum(df[self.flat] > 1)])[self.at])
        self.root = np.arange(len(ids))

    def linked(self, p: int, others: np.ndarray) -> np.ndarray:
        """Those of others that are linked with p: a bound, then the estimate, then the full sets."""
        most = np.minimum(self.shared[p], self.shared[others])
        others = others[100 * most >= self.percent * (self.n[p] + self.n[others] - most)]
        equal = (self.regs[others] == self.regs[p]).sum(axis=1)
        others = others[estimate(equal, self.n[others], self.n[p]) >= self.percent / 100 - MARGIN]
        if not len(others):
            return others
        own = np.zeros(self.size, dtype=bool)
        own[self.flat[self.at[p] : self.at[p + 1]]] = True
        lengths = self.n[others]
        ends = np.cumsum(lengths)
        take = np.arange(ends[-1]) + np.repeat(self.at[others] - np.concatenate([[0], ends[:-1]]), lengths)
        both = np.add.reduceat(own[self.flat[take]].astype(np.int64), np.concatenate([[0], ends[:-1]]))
        return others[100 * both >= self.percent * (self.n[p] + lengths - both)]

    def edges(self, first: int | None = None) -> list[tuple]:
        """Links that join everything linked, at most one fewer than there are sets. With first, only pairs with one of the first sets are compared."""
        out = []
        order = np.argsort(-self.shared / np.maximum(self.n, 1), kind="stable")
        pivots = order if first is None else order[order < first]
        left = self.n > 0
        for p in pivots[left[pivots]].tolist():
            left[p] = False
            others = np.flatnonzero(left & (self.root != self.root[p]))
            if not len(others):
                continue
            for q in self.linked(p, others).tolist():
                if self.root[q] != self.root[p]:
                    out.append((self.ids[p], self.ids[q]))
                    self.root[self.root == self.root[q]] = self.root[p]
        return out


def exact_shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' sets one after the other, as numbers that are equal exactly for equal shingles, and the sets' sizes."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    low = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    starts, ends, bounds = scan_words(low, offsets)
    ids = exact_ids(low, starts, ends, hash_words(low, starts))
    length = np.diff(bounds)
    text = np.repeat(np.arange(len(texts)), length)
    # Numbers of runs of 1, 2, ... words, each from those of the run before and of the next word.
    words = int(ids.max(initial=0)) + 1
    gram = ids
    for k in range(1, n):
        gram = np.unique(gram[:-1] * words + ids[k:], return_inverse=True)[1] if len(gram) > 1 else gram[:0]
    whole = np.arange(len(gram)) <= bounds[text[: len(gram)] + 1] - n
    gram, text = gram[whole], text[: len(whole)][whole]
    known: dict[bytes, int] = {}
    above = int(gram.max(initial=-1)) + 1
    few = [(t, above + known.setdefault(ids[bounds[t] : bounds[t + 1]].tobytes(), len(known))) for t in np.flatnonzero((length > 0) & (length < n)).tolist()]
    text, gram = np.concatenate([text, np.array([t for t, _ in few], np.int64)]), np.concatenate([gram, np.array([g for _, g in few], np.int64)])
    wide = above + len(known) + 1
    pairs = np.unique(text * wide + gram)
    return pairs % wide, np.bincount(pairs // wide, minlength=len(texts))


def _links(rows: DataFrame, keys: list[str], wide: str, percent: int, n: int, probed: bool = False) -> DataFrame:
    """(u, v): confirmed links inside the groups of keys; probed: only pairs with a row of role 0 are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, texts, bands, roles = None, [], [], [], []

        def done():
            if len(ids) > 1:
                order = sorted(range(len(ids)), key=lambda k: roles[k])
                regs = np.array([bands[k] for k in order], dtype=np.int64).view(np.uint16)
                probes = sum(r == 0 for r in roles)
                found = Block([ids[k] for k in order], [texts[k] for k in order], regs, percent, n).edges(probes if probed else None)
                if found:
                    u, v = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u, kind), pa.array(v, kind)], names=["u", "v"])

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            key_rows = list(zip(*(batch.column(k).to_pylist() for k in range(len(keys))), strict=True))
            columns = [batch.column(name).to_pylist() for name in ("doc_id", "role", "bands", "text")]
            for key, doc, role, band, text in zip(key_rows, *columns, strict=True):
                if key != now:
                    yield from done()
                    now, ids, texts, bands, roles = key, [], [], [], []
                ids.append(doc)
                roles.append(role)
                bands.append(band)
                texts.append(text)
        yield from done()

    dealt = rows.select(*keys, "doc_id", "role", "bands", "text").repartition(*keys).sortWithinPartitions(*keys)
    return map_batches(dealt, run, f"u {wide}, v {wide}")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept): one row for each row of docs.

    Documents are linked if 100 * intersection >= percent * union of their sets; component_id is the smallest id
    reachable over links, kept says whether it is the row's own. Null, empty and blank texts have no shingles and
    link with nothing. Repeated rows get a row each; rows that share an id count as one document with the links of
    all. Rows with a null id are returned with a null component and not kept. No rows give no rows. Other columns
    of docs are not looked at, whatever their names.

    Scale: texts of equal words are one class from the start, found by digest with partial aggregation. Buckets give
    only edges to their smallest id, so a bucket of any size costs one edge a row; the components of these edges
    hold together all candidates. Components are compared in blocks of bounded rows and bytes, each with the
    component's two best connected texts as pivots; a block gives at most one edge a row. Only if a component has
    several blocks are sets that no pivot joined compared with the other blocks: those that by their number of
    shingles unique to them in the component can still be linked at all.
    """
    wide = dict(docs.dtypes)[id_col]
    sig = materialize(sketches(docs, n, id_col, text_col), "nd-sketch")
    usable = sig.where("n > 0 and doc_id is not null")
    fp = ["fp0", "fp1"]
    classes = materialize(usable.groupBy(*fp).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "nd-classes")
    member = materialize(sig.join(classes, fp, "left").withColumn("rep", F.coalesce("rep", "doc_id")), "nd-member")
    reps = member.where("n > 0 and doc_id is not null and doc_id = rep").dropDuplicates(["doc_id", "fp0", "fp1"]).select("doc_id", "check", "size", "n", "bands")
    keyed = reps.select("doc_id", F.posexplode("bands").alias("band", "value")).select("doc_id", F.xxhash64("band", "value").alias("key"))
    centres = materialize(keyed.groupBy("key").agg(F.min("doc_id").alias("centre"), F.count("*").alias("size")).where("size > 1"), "nd-centres")
    star = materialize(keyed.join(centres, "key").groupBy("doc_id", "centre").agg(F.sum("size").alias("weight")), "nd-star")
    candidates = components(star.select(F.col("doc_id").alias("u"), F.col("centre").alias("v")))

    weight = star.groupBy("doc_id").agg(F.sum("weight").alias("weight"))
    found = candidates.select(F.col("id").alias("doc_id"), F.col("component").alias("cluster")).join(weight, "doc_id").join(reps, "doc_id")
    found = materialize(found, "nd-found")
    best = F.max(F.struct("weight", F.xxhash64("doc_id"), "doc_id"))
    sizes = found.groupBy("cluster").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.min("n").alias("least"), best.getField("doc_id").alias("pivot0"), F.min("doc_id").alias("pivot1"))
    sizes = materialize(sizes.withColumn("blocks", F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")), "nd-sizes")
    placed = found.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("check"))
    placed = texts.join(placed, ["doc_id", "check"]).dropDuplicates(["doc_id", "check"])
    members = materialize(placed.select("cluster", "block", "blocks", "least", "pivot0", "pivot1", "doc_id", "n", "size", "bands", "text"), "nd-texts")

    pivots = members.where("blocks > 1 and (doc_id = pivot0 or doc_id = pivot1)").withColumn("own", F.col("block")).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).where("block <> own").drop("own")
    links = materialize(_links(members.unionByName(pivots).withColumn("role", F.lit(1)), ["cluster", "block"], wide, percent, n), "nd-links")
    large = members.where("blocks > 1")
    if large.take(1):
        links = links.unionByName(_across_blocks(large, links, wide, percent, n))
    joined = components(links)
    out = member.join(joined.select(F.col("id").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def _alone(large: DataFrame, wide: str, n: int) -> DataFrame:
    """(doc_id, alone): at least how many shingles of a set no other set of its component has, for sets that have any; by hash,
    so never too many.

    Blocks send what they hold packed, cut by hash range, to where one range of a component is counted: rows grow
    with blocks, not with shingles, and a range holds about as much as a block.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, texts, blocks = None, [], [], 1

        def rows():
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            sets = [s for s, _, _ in shingle_sets(np.frombuffer(b"".join(texts), np.uint8), offsets, n)]
            flat = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
            values, first, counts = np.unique(flat, return_index=True, return_counts=True)
            owner = np.where(counts == 1, owner[first], -1).astype("<i4")
            part = np.searchsorted(np.arange(1, blocks) * (2.0**64 / blocks), values.astype(np.float64), side="right")
            for s in np.unique(part).tolist():
                at = part == s
                yield pa.RecordBatch.from_arrays([pa.array([now[0]], kind), pa.array([s], pa.int32()), pa.array([ids], pa.list_(kind)), pa.array([values[at].tobytes()], pa.binary()), pa.array([owner[at].tobytes()], pa.binary())], names=["cluster", "part", "ids", "shingle", "owner"])

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for cluster, block, blocks_, doc, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (cluster, block) != now:
                    if texts:
                        yield from rows()
                    now, ids, texts, blocks = (cluster, block), [], [], blocks_
                ids.append(doc)
                texts.append(text)
        if texts:
            yield from rows()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def rows():
            values, inverse, counts = np.unique(np.concatenate([v for _, v, _ in held]), return_inverse=True, return_counts=True)
            single, at, ids, alone = counts[inverse] == 1, 0, [], []
            for own, v, owner in held:
                hit = owner[single[at : at + len(v)] & (owner >= 0)]
                at += len(v)
                n = np.bincount(hit, minlength=len(own))
                ids += [own[i] for i in np.flatnonzero(n)]
                alone += n[n > 0].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(alone, pa.int64())], names=["doc_id", "alone"])

        for batch in batches:
            kind = batch.schema.field("cluster").type
            for cluster, part, ids, values, owner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (cluster, part) != now:
                    if held:
                        yield from rows()
                    now, held = (cluster, part), []
                held.append((ids, np.frombuffer(values, "<u8"), np.frombuffer(owner, "<i4")))
        if held:
            yield from rows()

    by_block = large.select("cluster", "block", "blocks", "doc_id", "text").repartition("cluster", "block").sortWithinPartitions("cluster", "block")
    sent = map_batches(by_block, send, f"cluster {wide}, part int, ids array<{wide}>, shingle binary, owner binary")
    counted = map_batches(sent.repartition("cluster", "part").sortWithinPartitions("cluster", "part"), count, f"doc_id {wide}, alone long")
    return counted.groupBy("doc_id").agg(F.sum("alone").alias("alone"))


def _across_blocks(large: DataFrame, links: DataFrame, wide: str, percent: int, n: int) -> DataFrame:
    """Links between different blocks of a component that the pivots have not already joined.

    What is left is compared, in slices of bounded size, with every other block of its component. Texts are sent once
    for each slice or block, so a component of very many blocks is dealt in groups of them instead, still bounded by bytes.
    """
    groups = lambda n: F.greatest(F.least(n, F.lit(GROUPS)), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("int")
    part = components(links).select(F.col("id").alias("doc_id"), "component")
    state = large.join(part, "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id"))
    main = materialize(state.where("doc_id = pivot0").select("cluster", F.col("part").alias("main")).distinct(), "nd-main")
    rest = state.join(main, "cluster").where("part <> main").join(_alone(large, wide, n), "doc_id", "left").withColumn("common", F.col("n") - F.coalesce("alone", F.lit(0)))
    # The smallest partner that could still have all of common: no smaller union is possible.
    partner = F.greatest("least", "common")
    rest = rest.where(100 * F.col("common") >= percent * (F.col("n") + partner - F.col("common")))
    rest = materialize(rest.select("cluster", "block", "blocks", "doc_id", "size", "bands", "text"), "nd-rest")
    slices_ = rest.groupBy("cluster").agg(groups(F.ceil(F.count("*") / BLOCK_ROWS)).alias("slices"))
    slices_ = materialize(slices_.join(large.groupBy("cluster").agg(groups(F.max("blocks")).alias("groups")), "cluster"), "nd-slices")
    grouped = F.pmod("block", F.least("groups", "blocks")).cast("int")
    probes = rest.join(slices_, "cluster").select("cluster", F.explode(F.expr("sequence(0, least(groups, blocks) - 1)")).alias("other"), F.pmod(F.xxhash64("doc_id", F.lit(3)), "slices").cast("int").alias("slice"), "doc_id", F.lit(0).alias("role"), "bands", "text", "block", "groups", "blocks")
    # A group of several blocks is also compared with the sets left over of its own blocks.
    probes = probes.where("groups < blocks or other <> block").drop("block", "groups", "blocks").withColumnRenamed("other", "block")
    base = large.join(slices_, "cluster").select("cluster", grouped.alias("block"), F.explode(F.expr("sequence(0, slices - 1)")).alias("slice"), "doc_id", F.lit(1).alias("role"), "bands", "text")
    return materialize(_links(base.unionByName(probes), ["cluster", "block", "slice"], wide, percent, n, probed=True), "nd-across")


def op5_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of all documents by two-word shingles; odd rows as near_duplicates says."""
    return near_duplicates(table(spark, sf_dir, "documents"), n=2)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 2 THEN list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) ELSE words END) AS shingle FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(id, root) AS (SELECT a, a FROM edge UNION SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.id),
c AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id, coalesce(c.root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = d.doc_id
"""
