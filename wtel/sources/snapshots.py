"""Readers for landed cluster snapshots: one JSON document per row, in the column ``doc``.

Every other column of the input (poll number, record time, node) is kept in front of the fields.
Documents that cannot be parsed, and empty or absent arrays, give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wtel import schemas


def _items(docs: DataFrame, path: str, item: T.StructType, pos: str | None = None) -> DataFrame:
    ids = [c for c in docs.columns if c != "doc"]
    parsed = docs.select(*ids, F.from_json("doc", schemas.nested(path, item)).alias("_doc"))
    array = F.col("_doc." + path)
    if pos is None:
        rows = parsed.select(*ids, F.explode(array).alias("_item"))
        return rows.select(*ids, "_item.*")
    rows = parsed.select(*ids, F.posexplode(array).alias(pos, "_item"))
    return rows.select(*ids, pos, "_item.*")


def read_cluster_metrics(docs: DataFrame) -> DataFrame:
    """One row per poll with the 23 cluster fields."""
    ids = [c for c in docs.columns if c != "doc"]
    schema = schemas.nested("clusterMetrics", schemas.CLUSTER, array=False)
    return (
        docs.select(*ids, F.from_json("doc", schema)["clusterMetrics"].alias("_m"))
        .where("_m is not null")
        .select(*ids, "_m.*")
    )


def read_apps(docs: DataFrame) -> DataFrame:
    """One row per application and poll."""
    return _items(docs, "apps.app", schemas.APP)


def read_queues(docs: DataFrame) -> DataFrame:
    """One row per scheduler queue and poll; ``resourcesUsed`` stays a struct."""
    return _items(docs, "scheduler.schedulerInfo.queues.queue", schemas.QUEUE)


def read_nodes(docs: DataFrame) -> DataFrame:
    """HTTP address of every node in a poll."""
    ids = [c for c in docs.columns if c != "doc"]
    return _items(docs, "nodes.node", schemas.NODE).select(*ids, "nodeHTTPAddress")


def read_node_apps(docs: DataFrame) -> DataFrame:
    """One row per node, application and poll, with its container ids."""
    return _items(docs, "apps.app", schemas.NODE_APP)


def container_items(docs: DataFrame) -> DataFrame:
    """Containers of every document as listed, with their place in it as ``_pos``."""
    return _items(docs, "containers.container", schemas.CONTAINER, pos="_pos")


def read_containers(docs: DataFrame, keys: Sequence[str] = ("poll_no", "node")) -> DataFrame:
    """One row per container and document; of repeated ids in one document the last one counts."""
    rows = container_items(docs)
    group = [*keys, "id"]
    rest = [c for c in rows.columns if c not in group and c != "_pos"]
    latest = rows.groupBy(*group).agg(F.max_by(F.struct(*rest), "_pos").alias("_last"))
    return latest.select(*keys, "id", "_last.*")
