"""Joins whose keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than HOT_ROWS, and than a HOT-th of all rows, is hot; so at most HOT
#: keys are, whatever the table, and what belongs to them can be broadcast.
HOT_ROWS, HOT = 256, 4096


def hot_from(rows: int) -> int:
    """How many rows a key of a table of ``rows`` rows may have without being hot."""
    return max(HOT_ROWS, rows // HOT)


def hot_keys(table: DataFrame, key: str, rows: int) -> DataFrame:
    """The hot values of ``key`` in a table of ``rows`` rows, in column ``hot``."""
    return table.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("hot")).count().filter(F.col("count") > hot_from(rows)).select("hot")


def join_unique(left: DataFrame, key: str, right: DataFrame, right_key: str, hot: DataFrame | None) -> DataFrame:
    """Left join of ``right``, which has at most one row for a key and no column of ``left``;
    ``hot`` is None if no key is.

    Rows with a hot key stay in place and meet their match by broadcast; of every other key
    a bounded share of the rows is shuffled.  Rows without a key must be kept out."""
    others = [c for c in right.columns if c != right_key]
    if hot is None:
        return left.join(right, F.col(key) == F.col(right_key), "left").select(*(F.col(f"`{c}`") for c in left.columns), *others)
    matches = F.broadcast(hot.join(right, F.col("hot") == F.col(right_key), "left").select("hot", *(F.col(c).alias(f"_hot_{c}") for c in others)))
    marked = left.join(matches, F.col(key) == F.col("hot"), "left")
    own = [F.col(f"`{c}`") for c in left.columns]
    there = marked.filter("hot IS NOT NULL").select(*own, *(F.col(f"_hot_{c}").alias(c) for c in others))
    moved = marked.filter("hot IS NULL").select(*own).join(right, F.col(key) == F.col(right_key), "left").select(*own, *others)
    return there.unionByName(moved)
