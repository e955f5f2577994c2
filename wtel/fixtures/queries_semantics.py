"""Registered queries over syntax trees."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wtel.fixtures.views import view
from wtel.plans import semantics
from wtel.sinks import tables
from wtel.sinks.staging import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def _facts(s: SparkSession, d: str) -> DataFrame:
    return semantics.analyse(view(s, d, "ast_nodes"))


def _stored(name: str) -> Query:
    """A fact table as it is read back after it was appended, and appended again by the same batch."""

    def run(s: SparkSession, d: str) -> DataFrame:
        root = f"{shared_folder(s).rstrip('/')}/facts-{uuid.uuid4().hex}"
        rows = semantics.fact_tables(view(s, d, "ast_nodes"))[name]
        for _ in range(2):
            tables.append_rows(rows, root, name, batch=0)
        return tables.read_table(s, root, name)

    return run


def _columns(s: SparkSession, d: str) -> DataFrame:
    return semantics.columns(_facts(s, d)).withColumnRenamed("query_id", "queryId")


QUERIES: dict[str, Query] = {
    "sem2_datasets": _stored("datasets"),
    "sem3_bucket_samples": lambda s, d: semantics.datasets(_facts(s, d))
    .where("isTabSample")
    .drop("isTabSample"),
    "sem4_clause_of": lambda s, d: semantics.clause_of(_facts(s, d)),
    "sem5_projections": _stored("projections"),
    "sem6_filters": _stored("filters"),
    "sem7_join_attributes": _stored("join_attributes"),
    "sem8_grouping_attributes": _stored("grouping_attributes"),
    "sem9_array_index": lambda s, d: _columns(s, d)
    .where("isArray")
    .select("queryId", "node_order", "colName", F.col("arrayIndex").cast("int").alias("arrayIndex")),
    "sem10_dim_lookup": lambda s, d: _columns(s, d)
    .where("isDimLookup")
    .select("queryId", "node_order", "colName", "dimTabName"),
    "jn2_resolve_column_table": lambda s, d: _columns(s, d).select(
        "queryId", "node_order", "clause", "colName", "tabName"
    ),
}
