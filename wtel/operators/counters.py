"""Counters, gauges and the tables of registered tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counter_totals(packets: DataFrame, first_counts_one: bool = False, seq: str = "seq") -> DataFrame:
    """Total per counter.

    With ``first_counts_one`` the first packet of a name adds 1 whatever its value.
    """
    total = F.sum("value")
    if first_counts_one:
        total = total + 1 - F.min_by("value", seq)
    return packets.where("kind = 'c'").groupBy("name").agg(total.cast("long").alias("value"))


def gauge_latest(packets: DataFrame) -> DataFrame:
    """Last value per gauge by time, then sequence."""
    latest = F.max_by("value", F.struct("ts", "seq")).cast("long").alias("value")
    return packets.where("kind = 'g'").groupBy("name").agg(latest)


def registry_values(registry: DataFrame, values: DataFrame) -> DataFrame:
    """Every registered tag with its current value; one that was never seen has -1.

    ``values`` has (table_name, tag, value): a counter and a gauge of one name are different tags.
    """
    return registry.join(values.select("table_name", "tag", "value"), ["table_name", "tag"], "left").select(
        "table_name", "tag", F.coalesce("value", F.lit(-1)).alias("value")
    )


def tag_values(packets: DataFrame) -> DataFrame:
    """Current value per kind and name: the total of a counter, the last value of a gauge."""
    total = F.sum("value").cast("long")
    latest = F.max_by("value", F.struct("ts", "seq")).cast("long")
    return (
        packets.groupBy("kind", "name")
        .agg(total.alias("total"), latest.alias("latest"))
        .select(
            F.when(F.col("kind") == "c", "counts").otherwise("gauges").alias("table_name"),
            F.col("name").alias("tag"),
            F.when(F.col("kind") == "c", F.col("total")).otherwise(F.col("latest")).alias("value"),
        )
    )


def current_tags(registry: DataFrame, values: DataFrame) -> DataFrame:
    """The ``counts`` and ``gauges`` tag tables, values as text; -1 for a tag without one."""
    return registry_values(registry, values).withColumn("value", F.col("value").cast("string"))


def scheduler_totals(queues: DataFrame) -> DataFrame:
    """Totals over the queues of each poll; ``maxApplications`` is the sum of the queues' limits."""
    totals = {
        "totalContainers": "numContainers",
        "totalActiveApplications": "numActiveApplications",
        "totalApplications": "numApplications",
        "maxApplications": "maxApplications",
    }
    return queues.groupBy(F.col("record_time").alias("RecordTime")).agg(
        *[F.sum(F.coalesce(c, F.lit(0))).alias(name) for name, c in totals.items()]
    )
