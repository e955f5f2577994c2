"""From raw documents to token ids: judge, drop near copies, mask secrets, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; what it
returns is written as Parquet and read again as the next one's documents.

Stages take nulls in any column, repeated rows and ids, texts of any length, and columns beside those of
``documents``, which they leave out. An empty table gives an empty result. What becomes of odd rows is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wtel.llm import bpe, mixing, quality, secrets, setsketch
from wtel.llm.common import ranks_path, staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and read like the trusted ones.

    Null, empty and blank texts go. Repeated rows are judged alike and stay, null ids too. Without
    trusted labels only the rules decide.
    """
    return quality.kept_documents(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    The smallest id stays, a null id only if its group has no other; of rows that repeat it, one. Texts without words are in
    no group and all stay.
    """
    return setsketch.one_of_each(docs.select(*COLUMNS), words=5)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; null and empty texts as they are, repeated rows alike."""
    return secrets.masked_documents(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: up to twice, some not at all.

    A null source is a source. Null and blank texts have no words and are not taken. Rows that agree in id, source and size
    are taken alike; equal places in the seeded order go by id and size.
    """
    return mixing.mixed_documents(docs.select(*COLUMNS))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document of the mix; null and empty texts have none, repeated rows each have theirs."""
    encoded = bpe.encode(docs, ranks_path())
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("mix_sources", mix_sources),
    ("byte_bpe", byte_bpe),
]
#: Sketches, lexing and merges are beyond SQL; the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
