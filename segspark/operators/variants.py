"""Queries over variant calls with an array ``samples`` of (num, name, tags).

Row conditions are SQL expressions (``calls.filter("qual > 30 AND info['DP'] > 8")``);
conditions on samples are functions of a sample column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Condition = Callable[[Column], Column]


def tag(sample: Column, name: str, kind: str = "string") -> Column:
    """A tag of a sample; null if it is absent or not of that type."""
    return F.try_element_at(sample["tags"], F.lit(name)).try_cast(kind)


def any_sample(condition: Condition) -> Column:
    return F.coalesce(F.exists("samples", condition), F.lit(False))


def all_samples(condition: Condition) -> Column:
    return F.coalesce(F.forall("samples", condition), F.lit(False))


def at_least(n: int, condition: Condition) -> Column:
    return F.size(F.filter("samples", condition)) >= n


def for_sample(num: int, condition: Condition) -> Column:
    """Whether sample ``num`` is there and fulfils the condition."""
    return F.coalesce(F.exists("samples", lambda s: (s["num"] == num) & condition(s)), F.lit(False))


def compare(a: int, b: int, condition: Callable[[Column, Column], Column]) -> Column:
    """A condition on two samples by number; false if one is missing or lacks a tag."""
    one = lambda k: F.get(F.filter("samples", lambda s: s["num"] == k), F.lit(0))
    return F.coalesce(condition(one(a), one(b)), F.lit(False))


def field_of(num: int, name: str, kind: str = "string") -> Column:
    """A tag of sample ``num``, null if it is missing."""
    return tag(F.get(F.filter("samples", lambda s: s["num"] == num), F.lit(0)), name, kind)


def split_key(key: Column) -> tuple[Column, Column]:
    """Chromosome and position of ``chrom@pos``, cut at the last @."""
    return F.regexp_extract(key, "(.+)@(.+)", 1), F.regexp_extract(key, "(.+)@(.+)", 2).try_cast("long")


def select_keys(calls: DataFrame, keys: DataFrame) -> DataFrame:
    """Calls whose ``key`` is in ``keys``."""
    return calls.join(keys.select("key"), "key", "left_semi")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("key").intersect(b.select("key"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("key").union(b.select("key")).distinct()


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("key").subtract(b.select("key"))


def last_per_key(calls: DataFrame, order: str) -> DataFrame:
    """Of calls with one key the last in ``order``."""
    w = Window.partitionBy("key").orderBy(F.desc(order))
    return calls.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def filtered(calls: DataFrame, condition: str | Column, fields: list | None = None, count: bool = False, chunk: int = 10_000, max_chunks: int | None = None) -> DataFrame:
    """Filter, then project or count; ``max_chunks`` limits what is scanned."""
    rows = calls if max_chunks is None else calls.limit(chunk * max_chunks)
    rows = rows.filter(condition)
    if count:
        return rows.agg(F.count("*").alias("n"))
    return rows.select(*fields) if fields else rows


def natural_order(rows: DataFrame, *ties: str) -> DataFrame:
    """Chromosomes by number where they are numbers, then by name, then positions."""
    return rows.orderBy(F.col("chrom").try_cast("double").asc_nulls_last(), "chrom", "pos", *ties)
