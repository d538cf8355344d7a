"""A corpus made ready for training: five stages over documents, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm import forest, mixing, packing, repeats, toxicity
from gradus.plans.scratch import CREATED, Scratch, remove_since


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return forest.one_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes over 50-byte strings of earlier documents go; n_chars, where there is one, follows."""
    named = docs.select("doc_id", "text", *(F.col(c).alias(f"own_{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")))
    left = repeats.without_repeats(named)
    columns = {c: F.col(f"own_{i}") for i, c in enumerate(docs.columns)} | {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return left.select(*(columns[c].alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or go as their source's target asks."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", drop_repeats),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier and the tokenizer can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        mark = len(CREATED)
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        remove_since(spark, mark)  # the stage's own intermediate tables
    return docs
