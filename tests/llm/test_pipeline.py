"""The pipeline's stages one by one against plain Python, on a small corpus, and the queries' columns."""

import os
from collections import defaultdict

import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from factorspark.llm import packing, quality, toxicity
from tests.llm.test_near_duplicates import brute
from tests.llm.test_substring import brute as brute_windows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from factorspark.llm.common import materialize, table

    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, SF), name)
        out.append((name, docs.toPandas(), after.toPandas(), docs.columns))
        docs = after
    return out


def test_stages_keep_the_columns(stages):
    assert [s[0] for s in stages] == ["toxicity", "quality", "near_duplicates", "substring_dedup", "packing"]
    for _, before, after, columns in stages[:-1]:
        assert list(after.columns) == columns and len(after) <= len(before)


def test_filters_follow_their_models(spark, stages):
    _, before, after, _ = stages[0]
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    want = toxicity.score(docs, toxicity.train(docs, labels)).where(f"p_toxic < {toxicity.THRESHOLD}").toPandas().doc_id
    assert sorted(after.doc_id) == sorted(want) and len(after) > 0.6 * len(before)
    _, before, after, _ = stages[1]
    scores = quality.score(docs, quality.train(docs, labels)).toPandas().set_index("doc_id").quality_score
    assert sorted(after.doc_id) == sorted(i for i in before.doc_id if scores[i] >= quality.THRESHOLD)


def test_one_of_each_group_stays(stages):
    _, before, after, _ = stages[2]
    groups = brute(list(zip(before.doc_id, before.text, strict=True)), 5, 80)
    assert sorted(after.doc_id) == sorted(i for i, (_, c) in groups.items() if c == i)


def test_repeated_windows_go(stages):
    _, before, after, _ = stages[3]
    texts = dict(zip(after.doc_id, after.text, strict=True))
    original = dict(zip(before.doc_id, before.text, strict=True))
    for i, n, kept in brute_windows(list(zip(before.doc_id, before.text, strict=True)), 20):
        assert texts[i] == (original[i] if n == len(kept) else b" ".join(kept).decode())
    assert (after.n_chars == after.text.str.len()).all()


def test_all_tokens_are_packed(stages):
    _, before, after, _ = stages[4]
    tok = packing.tokenizer(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    length = after.groupby("doc_id").length.sum()
    for i, t in zip(before.doc_id, before.text, strict=True):
        assert length[i] == len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    parts = defaultdict(int)
    for r in after.itertuples():
        parts[r.sequence_id] += r.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in parts.values())


def test_run_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_query_is_registered(spark):
    names = {n.split("_")[0] for n in entry.queries() if n.startswith("op")}
    assert names == {f"op{k}" for k in range(1, 11)} and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.exists(corpus_pipeline.__file__)


def test_row_groups_and_batches_are_bounded(spark, tmp_path):
    """Tasks that read and write texts together would hold 128 MB of a row group and 4096 texts each."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    from factorspark.llm.common import GROUP_BYTES, READ_ROWS, bounded, materialize, table

    letters = np.random.default_rng(1).integers(97, 123, (500, 100_000), dtype=np.uint8)
    pq.write_table(pa.table({"doc_id": range(500), "text": [row.tobytes().decode() for row in letters]}), tmp_path / "documents.parquet")
    docs = table(spark, str(tmp_path), "documents")
    out = materialize(docs.coalesce(1), "groups")
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in out.inputFiles()]
    sizes = [f.row_group(k).total_byte_size for f in files for k in range(f.num_row_groups)]
    assert sum(f.num_rows for f in files) == 500 and max(sizes) < 1.5 * GROUP_BYTES < sum(sizes)
    assert out.exceptAll(docs).isEmpty()

    rows = "spark.sql.parquet.columnarReaderBatchSize"
    assert int(spark.conf.get(rows)) == READ_ROWS
    spark.conf.set(rows, "100")
    bounded(spark)
    assert spark.conf.get(rows) == "100"
    spark.conf.set(rows, str(READ_ROWS))
