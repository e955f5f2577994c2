"""Tables that are replaced as a whole without a moment in which a reader finds none or half of one.

A version is a folder ``version=<n>``. Once it is written, an empty file ``_done/<n>`` is made; readers
take the version with the greatest such number. A writer that dies in between leaves the old one
in force. The version before the current one stays for readers that have just looked it up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none if it is absent."""
    fs, at = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def drop(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def folder(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/version={version}"


def published(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n) for n in names(spark, f"{root.rstrip('/')}/_done") if n.isdigit())


def latest(spark: SparkSession, root: str) -> int | None:
    """Number of the version in force; none before the first."""
    done = published(spark, root)
    return done[-1] if done else None


def write(df: DataFrame, root: str, version: int, by: Sequence[str] = ()) -> None:
    """Write a version that nobody reads yet."""
    df.write.mode("overwrite").partitionBy(*by).parquet(folder(root, version))


def switch(spark: SparkSession, root: str, version: int, kept: int = 2) -> None:
    """Put a written version in force, and drop those before the last ``kept``."""
    fs, mark = _at(spark, f"{root.rstrip('/')}/_done/{version}")
    fs.create(mark, True).close()
    for old in published(spark, root)[:-kept]:
        drop(spark, f"{root.rstrip('/')}/_done/{old}")
        drop(spark, folder(root, old))


def publish(df: DataFrame, root: str, version: int | None = None, by: Sequence[str] = (), replace: bool = False) -> int:
    """Replace the table at ``root`` by the rows; gives the version's number.

    A version that is published already stays as it is, unless ``replace`` says that it is written anew, as by a batch that
    is repeated and must not find its own result.
    """
    spark = df.sparkSession
    now = latest(spark, root)
    if version is None:
        version = 0 if now is None else now + 1
    if replace or now is None or version > now:
        write(df, root, version, by)
        switch(spark, root, version)
    return version


def read(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(folder(root, version))


def current(spark: SparkSession, root: str) -> DataFrame:
    """The table in force."""
    version = latest(spark, root)
    if version is None:
        raise FileNotFoundError(f"no version is published at {root}")
    return read(spark, root, version)
