"""Writers for the fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wtel import schemas
from wtel.sinks import versions


def table_path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}"


def ensure_tables(spark: SparkSession, root: str, fmt: str = "parquet") -> list[str]:
    """Create every fact table that is absent under ``root``; existing ones stay as they are."""
    paths = []
    for table, schema in schemas.TABLES.items():
        path = table_path(root, table)
        spark.createDataFrame([], schema).write.mode("ignore").format(fmt).save(path)
        paths.append(path)
    return paths


def conform(df: DataFrame, table: str) -> DataFrame:
    """The columns of ``table`` in stored order; a missing column or a lossy type is an error."""
    return df.to(schemas.TABLES[table])


def append_rows(
    df: DataFrame, root: str, table: str, fmt: str = "parquet", batch: str | int | None = None
) -> None:
    """Append rows that fit the table's schema; read them with ``read_table``.

    With ``batch``, the name of this append, a repeated append replaces what it wrote before and the rows are
    there once.
    """
    _append(conform(df, table), root, table, fmt, batch)


def _append(rows: DataFrame, root: str, table: str, fmt: str, batch: str | int | None) -> None:
    path = table_path(root, table)
    if batch is None:
        rows.write.mode("append").format(fmt).save(path)
    else:
        rows.write.mode("overwrite").format(fmt).save(f"{path}/batch={batch}")


def read_table(spark: SparkSession, root: str, table: str, fmt: str = "parquet") -> DataFrame:
    """All rows of a fact table, whether appended by batch or not."""
    reader = spark.read.format(fmt).schema(schemas.TABLES[table]).option("recursiveFileLookup", "true")
    return reader.load(table_path(root, table))


def metric_rows(df: DataFrame, table: str, longest: int | None = None) -> DataFrame:
    """Rows of a long metric table as stored; values are whole unless a longest length is given."""
    if longest is not None:
        df = df.withColumn("Value", F.substring("Value", 1, longest))
    return conform(df, table)


def append_metric(
    df: DataFrame, root: str, table: str, fmt: str = "parquet", longest: int | None = None, batch: str | int | None = None
) -> None:
    """Append to a long metric table; ``batch`` as in ``append_rows``."""
    _append(metric_rows(df, table, longest), root, table, fmt, batch)


def initial_tags(registry: DataFrame) -> DataFrame:
    """Every registered tag with value 0, as written when collection starts."""
    return registry.select("table_name", "tag", F.lit("0").alias("value")).dropDuplicates(
        ["table_name", "tag"]
    )


def write_tags(tags: DataFrame, root: str) -> int:
    """Publish the tag tables, one directory per table; the tables before stay readable until then."""
    return versions.publish(tags, table_path(root, "tags"), by=["table_name"])


def read_tags(spark: SparkSession, root: str) -> DataFrame:
    """The tag tables in force."""
    return versions.current(spark, table_path(root, "tags"))


# File names of a full and of a preliminary query record.
RECORD_FILE = "HiveQueryInfo.json"
PRELIMINARY_FILE = "HiveQueryInfoPre.json"


def record_path(top: str | Column, state: str, query_id: str, preliminary: Column) -> Column:
    """``<top>/<state>/<query id>/<file>`` of a query record."""
    name = F.when(preliminary, PRELIMINARY_FILE).otherwise(RECORD_FILE)
    root = F.col(top) if isinstance(top, str) else top
    return F.concat_ws("/", root, F.col(state), F.col(query_id), name)


def write_query_info(records: DataFrame, root: str) -> None:
    """One JSON line per query record, in a directory per state."""
    ids = ["state", "queryId", "path"]
    body = [c for c in records.columns if c not in ids]
    records.select(*ids, F.to_json(F.struct("queryId", *body)).alias("record")).write.mode(
        "append"
    ).partitionBy("state").json(root)


#: Documents a file has at most; a compressed file is read by one task.
FILE_DOCUMENTS = 1 << 15


def write_documents(records: DataFrame, root: str, per_query: bool = False) -> None:
    """Whole record documents (state, queryId, record), a line each, in a directory per state, as compressed files.

    With ``per_query`` every query has a directory of its own below its state, as many plain files as queries.
    """
    by = ["state", "queryId"] if per_query else ["state"]
    writer = records.select(*by, F.col("record").alias("value")).write.mode("append").partitionBy(*by)
    if not per_query:
        writer = writer.option("compression", "gzip").option("maxRecordsPerFile", FILE_DOCUMENTS)
    writer.text(root)


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """Documents as written by ``write_documents``: state and doc."""
    rows = spark.read.text(root)
    return rows.select("state", F.col("value").alias("doc"))
