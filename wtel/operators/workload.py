"""Selection of logged queries for analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wtel.functions.ordered import number_all
from wtel.functions.text import WATCHED_TABLES, query_class
from wtel.functions.zones import epoch_ms



def classify(log: DataFrame, watched: Sequence[str] = WATCHED_TABLES) -> DataFrame:
    return log.withColumn("class", query_class("query_string", watched))


def explain_rewrite(log: DataFrame, watched: Sequence[str] = WATCHED_TABLES) -> DataFrame:
    """Retrieval queries, prefixed for a plan-only run."""
    kept = classify(log, watched).where("class = 'retrieval'")
    return kept.withColumn("query_string", F.concat(F.lit("EXPLAIN "), "query_string")).drop("class")


def class_counts(log: DataFrame, watched: Sequence[str] = WATCHED_TABLES) -> DataFrame:
    """How many DDL, explain and retrieval queries were seen; ignored ones are not counted."""
    counted = classify(log, watched).where("class <> 'ignored'")
    return counted.groupBy("class").agg(F.count("*").alias("n"))


def register_queries(log: DataFrame, last_id: int = 0) -> DataFrame:
    """Number queries in start order after ``last_id``: the ``queries`` table."""
    timed = log.withColumn("_ms", epoch_ms(F.col("start_time")))
    numbered = number_all(timed, ["_ms", "query_id"], "_no")
    return numbered.select(
        "query_id",
        (F.col("_no") + F.lit(last_id)).alias("queryId"),
        F.col("query_string").alias("queryString"),
    )
