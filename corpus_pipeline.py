"""The corpus pipeline: from documents to packed token sequences, a stage at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm import mixing, packing, quality, simhash, substrings
from tidewire.llm.common import stage, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3 stay, as they are."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity 0.8) the document with the smallest id stays."""
    return simhash.one_of_similar(docs, words=5, distance=14, least=(4, 5))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words and more that occurred before are cut out; a document left without words goes."""
    return substrings.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in the weights 3, 1, 2, repeating, over 150 % of the words; a document taken twice is two rows."""
    return mixing.mixed_documents(docs, cycle=(3, 1, 2), share=1.5, most=2)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The stages' models, hashes and tokenizer are out of SQL's reach. A test holds the whole run, stage by stage, against a plain version in
#: memory (tests/llm/test_whole_pipeline.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
