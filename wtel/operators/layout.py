"""State of query records, as told by the directory each one lies in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wtel.sinks.tables import PRELIMINARY_FILE, RECORD_FILE

# The states in the order a record passes through them.
STATES = ["executing", "completed", "analyzed", "archived"]


def state_rank(state: str = "state") -> Column:
    """1 for the first state; null for a directory that is no state."""
    position = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col(state))
    return F.when(position > 0, position)


def log_dir_valid(files: DataFrame) -> DataFrame:
    """Per top directory: is there a completed query with a full or preliminary record?"""
    good = (F.col("state") == "completed") & F.col("file").isin(RECORD_FILE, PRELIMINARY_FILE)
    return files.groupBy("top").agg(F.bool_or(good).alias("valid"))


def query_ids(files: DataFrame, state: str) -> DataFrame:
    """Queries that have a directory in the state."""
    return files.where(F.col("state") == state).select("top", "query_id").distinct()


def query_state(files: DataFrame) -> DataFrame:
    """Current state of each query: the furthest one it has a directory in."""
    return files.groupBy("top", "query_id").agg(F.max_by("state", state_rank()).alias("state")).where(
        "state is not null"
    )


def preferred_record(files: DataFrame) -> DataFrame:
    """Each query's full record if there is one, else its preliminary one, from the furthest state.

    Of several in one place the greatest text counts, whatever the order in which rows meet.
    """
    is_final = F.when(F.col("file") == RECORD_FILE, 1).when(F.col("file") == PRELIMINARY_FILE, 0)
    best = F.when(is_final.isNotNull(), F.struct(is_final, state_rank(), F.col("record")))
    return files.groupBy("top", "query_id").agg(F.max_by("record", best).alias("record")).where(
        "record is not null"
    )
