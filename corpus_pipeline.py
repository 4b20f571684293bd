"""The training-data pipeline: language ID, toxicity, n-gram Jaccard join, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet and read again. All
but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import jaccard_join, language, packing, toxicity
from strandline.llm.common import cut, table
from strandline.session import ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose language scores at least language.LEAST; the model is fitted on docs' own languages."""
    ship(spark)
    return language.keep_identified(docs, language.train(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3; the lexicon is fitted on the labelled ones among docs."""
    ship(spark)
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 over five-word shingles, the smallest doc_id stays."""
    ship(spark)
    return jaccard_join.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    ship(spark)
    return packing.pack(packing.token_pieces(docs, packing.vocabulary(), with_ids=False, specials=True))


STAGES = [("language ID", identify_language), ("toxicity", drop_toxic), ("n-gram Jaccard join", drop_near_copies), ("best-fit packing", pack_sequences)]

#: The stages are fitted models, a similarity join and a packing heuristic: not SQL. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
