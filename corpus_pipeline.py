"""The corpus pipeline: five stages, each one operator's decision taken on all that the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuslens.llm import mixing, packing, quality, simhash, substring
from corpuslens.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. A null or empty text has no words and goes; nulls elsewhere don't matter;
    repeated rows are judged alike; an empty table stays empty."""
    return quality.keep_good(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id: those that op4's SimHash fingerprints link,
    and those of an exact similarity of 0.8 (five-word shingles). Of equal ids one row; rows without an id stay. Texts without a
    word, null and empty ones too, are a group; an empty table stays empty."""
    return simhash.keep_unlike(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that a document with a smaller doc_id holds go from the texts; rows of one id keep theirs.
    Texts without such a passage, nulls too, stay as they are; an empty table stays empty."""
    return substring.cut_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice (as repeated rows). Repeated rows are taken one by one; a
    null source is a source; documents without words are not taken; an empty table stays empty."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row's token ids in sequences of 1024. A null or empty text is its end id alone; repeated rows
    are packed each; an empty table gives no rows."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_rules),
    ("simhash", simhash_dedup),
    ("substring", substring_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenizer ids, model scores and fingerprints are beyond SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
