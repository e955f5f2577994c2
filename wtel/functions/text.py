"""Small text expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_alias(alias: str | Column) -> Column:
    """Text after the last colon; trailing colons do not count, null stays null."""
    c = F.col(alias) if isinstance(alias, str) else alias
    bare = F.regexp_replace(c, ":+$", "")
    return F.substring_index(bare, ":", -1)


def full_table_name(db: str | Column, table: str | Column) -> Column:
    """``db.table``, with ``default`` for a missing database."""
    d = F.col(db) if isinstance(db, str) else db
    t = F.col(table) if isinstance(table, str) else table
    return F.concat_ws(".", F.coalesce(d, F.lit("default")), t)


def joined_or_empty(parts: str | Column) -> Column:
    """Array as comma-separated text; a null array gives the empty text."""
    return F.coalesce(F.array_join(parts, ","), F.lit(""))


# Fixed value: the three tables the query filter watches when the caller names none.
WATCHED_TABLES = ("impressions", "rtbids", "actions")


def query_class(query: str | Column, watched: Sequence[str] = WATCHED_TABLES) -> Column:
    """``ddl``, ``explain``, ``ignored`` or ``retrieval``; the first matching test decides."""
    q = F.lower(F.col(query) if isinstance(query, str) else query)
    names_one = F.lit(False)
    for table in watched:
        names_one = names_one | F.contains(q, F.lit(table.lower()))
    return (
        F.when(~F.contains(q, F.lit("select")), "ddl")
        .when(q.rlike("^\n{0,2}explain"), "explain")
        .when(~names_one, "ignored")
        .otherwise("retrieval")
    )


def labelled_comment(entries: str | Column) -> Column:
    """Ordered (title, value) structs as ``title: v1, v2`` lines, titles in first-seen order.

    Empty and null values are left out. No entry at all gives the empty text.
    """
    e = F.col(entries) if isinstance(entries, str) else entries
    kept = F.filter(e, lambda x: F.coalesce(x["value"], F.lit("")) != "")
    titles = F.array_distinct(F.transform(kept, lambda x: x["title"]))

    def line(title: Column) -> Column:
        mine = F.filter(kept, lambda x: x["title"] == title)
        return F.concat(title, F.lit(": "), F.array_join(F.transform(mine, lambda x: x["value"]), ", "))

    return F.array_join(F.transform(titles, line), "\n")
