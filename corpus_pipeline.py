"""Five stages from raw documents to packed sequences: toxicity, quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared folder and
reads again for the next one. All but the last return the columns of documents; the last returns packed pieces. Columns
of documents keep their own values, also under names that an operator uses for its results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.llm import minhash, packing, quality, substring, toxicity
from factorspark.llm.common import WRITTEN, columns_of, free_name, materialize, remove_written, table

TOKENIZER = "word_bpe_49k.json"


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose last chain probability reaches the threshold go; the chain is trained on the labelled documents of sf_dir.

    Null and empty texts stay unless an empty model says otherwise, null ids are judged like others, repeated rows go
    or stay together; no documents give none.
    """
    chain = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    prefix = "p_"
    while any(free_name(docs, prefix + c) != prefix + c for c in toxicity.CATEGORIES):
        prefix = f"_{prefix}"
    return columns_of(toxicity.score(docs, chain, prefix=prefix).where(F.col(f"{prefix}toxic") < toxicity.THRESHOLD), docs.columns)


def quality_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold go, null, empty and blank texts among them, which score 0.

    Null ids are judged like others, repeated rows go or stay together; no documents give none.
    """
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    name = free_name(docs, "quality_score")
    return columns_of(quality.score(docs, model, name=name).where(F.col(name) >= quality.THRESHOLD), docs.columns)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id (five-word shingles, similarity 0.8).

    Documents without words are alike to none and stay; so do rows with a null id, which cannot be told apart. Rows that
    share an id are one document, which stays if any of them would; no documents give none.
    """
    kept = minhash.near_duplicates(docs, n=5, percent=80).where("kept").select("doc_id").distinct()
    return columns_of(docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")), docs.columns)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by windows of 20 words that also start earlier go from the texts, and n_chars follows; every row stays.

    Null texts stay null with no characters counted, rows with a null id stay as they are, rows that share an id are
    treated alike; no documents give none.
    """
    out = substring.remove_repeats(docs, count=None)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return columns_of(out, docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens, each with the corpus's mixture of sources.

    Null and empty texts are one token, the end's; null ids and repeated rows are documents of their own; no documents
    give no pieces. Other columns than id, source and text are not looked at.
    """
    import public_tokenizers as tokenizers

    return packing.pack(packing.tokenize(docs, tokenizers.path(TOKENIZER)))


STAGES = [("toxicity", toxic_out), ("quality", quality_out), ("near_duplicates", near_duplicates_out), ("substring_dedup", repeats_out), ("packing", packed)]

#: Learned models and tokenizers have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents. Once a stage's rows are written, what led to them is removed."""
    docs, before = table(spark, sf_dir, "documents"), len(WRITTEN)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        remove_written(spark, before, keep=1)
    return docs
