"""Interval joins by one sweep over ranges of the genome.

The left rows are counted by chromosome and bin of their starts; bins in order make up ranges
of about ``TARGET`` rows, and a bin with more is dealt over several parts of its range.
Each left row goes to one part; a right row goes to every part of each range that it reaches
into, however long it is.  In a part both sides are sorted and merged in one pass, so left
rows without a partner are known where they are, and no pair appears twice.  Only counts of
bins, whose number is that of the genome's length, are moved before that; they are broadcast
as long as they are few.  Right rows may hold long strings that compress to little, so they
are never broadcast, however small a plan takes them for."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from segspark.sources.scratch import written

#: Bases of a bin, left rows of a range, and candidate pairs that are looked at together.
BIN, TARGET, TOGETHER = 1_000_000, 25_000, 1 << 20
#: Bins that are broadcast; more of them are joined by a shuffle.
BROADCAST_BINS = 1 << 18


def ranges(left: DataFrame, target: int = TARGET, size: int = BIN) -> DataFrame:
    """``chrom, bin, range, parts`` of the bins that ``left`` (chrom, start, end) begins in, and
    ``reach``, the most bases that a row of the bin goes on."""
    bins = left.filter("chrom IS NOT NULL AND start IS NOT NULL").groupBy("chrom", F.floor(F.col("start") / size).alias("bin"))
    counted = bins.agg(F.count("*").alias("n"), F.max(F.col("end") - F.col("start")).alias("reach"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("chrom").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.select("chrom", "bin", F.floor(before / target).alias("range"), F.ceil(F.col("n") / target).cast("int").alias("parts"), "reach")


def overlapping(start: np.ndarray, end: np.ndarray, r_start: np.ndarray, r_end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (left, right) of all pairs that share a base, in stretches of left rows."""
    order = np.argsort(r_start, kind="stable")
    begins, ends = r_start[order], r_end[order]
    # The first right row that may still go on is where the running maximum of ends gets there.
    low = np.searchsorted(np.maximum.accumulate(ends), start, side="left") if len(ends) else np.zeros(len(start), np.int64)
    count = np.maximum(np.searchsorted(begins, end, side="right") - low, 0)
    total, at = np.cumsum(count), 0
    while at < len(start):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + TOGETHER, side="right")))
        n = count[at:upto]
        rows = np.repeat(np.arange(at, upto), n)
        right = np.repeat(low[at:upto] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        meet = ends[right] >= start[rows]
        yield rows[meet], order[right[meet]]
        at = upto


def sweep_join(left: DataFrame, right: DataFrame, key: str, merge: Callable[[pa.Table, pa.Table], pa.Table], schema: StructType | str, target: int = TARGET, size: int = BIN) -> DataFrame:
    """``merge`` of the rows of ``left`` (chrom, start, end, ...) and ``right`` (chrom, r_start,
    r_end, ..., told apart by ``key``) that lie in one part, for all parts.

    ``left`` is read twice and must give the same rows each time."""
    dealt = written(ranges(left, target, size))
    dealt = dealt.hint("broadcast" if dealt.count() <= BROADCAST_BINS else "merge")
    bin_of = lambda c: F.floor(F.col(c) / size)
    keyed = left.withColumn("_bin", bin_of("start")).join(dealt.select(F.col("chrom").alias("_chrom"), F.col("bin").alias("_of"), "range", "parts"), (F.col("chrom") == F.col("_chrom")) & (F.col("_bin") == F.col("_of")), "left")
    mixed = F.xxhash64(*(F.col(f"`{c}`") for c in left.columns))
    part = F.pmod(mixed, F.coalesce("parts", F.lit(64))).cast("int")
    mine = keyed.select(*(F.col(f"`{c}`") for c in left.columns), F.coalesce("range", F.lit(-1).cast("long")).alias("_range"), part.alias("_part"))
    reach = dealt.agg(F.max("reach")).first()[0] or 0
    touched = right.filter("r_start <= r_end").select(F.col("chrom").alias("_chrom"), F.col(key).alias("_key"), F.explode(F.sequence(F.floor((F.col("r_start") - reach) / size), bin_of("r_end"))).alias("_bin"))
    met = touched.join(dealt.select("chrom", "bin", "range", "parts"), (F.col("_chrom") == F.col("chrom")) & (F.col("_bin") == F.col("bin"))).select("_key", F.col("range").alias("_range"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_part")).distinct()
    theirs = right.join(met.hint("merge"), F.col(key) == F.col("_key")).drop("_key")
    by = [F.col("chrom"), F.col("_range"), F.col("_part")]
    own, others = left.columns, right.columns

    def sweep(a: pa.Table, b: pa.Table) -> pa.Table:
        return merge(a.select(own).sort_by("start"), b.select(others).sort_by("r_start"))

    return mine.groupBy(*by).cogroup(theirs.groupBy(*by)).applyInArrow(sweep, schema)


def pairs(how: str = "inner", drop: Callable[[pa.Table, pa.Table, np.ndarray, np.ndarray], np.ndarray] | None = None) -> Callable[[pa.Table, pa.Table], tuple[np.ndarray, np.ndarray]]:
    """Places (left, right) of pairs in a part; right is -1 for left rows without a partner
    if ``how`` is ``left``.  ``drop`` marks pairs that don't count."""

    def find(a: pa.Table, b: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        number = lambda t, c: t[c].to_numpy().astype(np.float64)  # noqa: E731  null: NaN, which meets nothing
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if len(b):
            for i, j in overlapping(number(a, "start"), number(a, "end"), number(b, "r_start"), number(b, "r_end")):
                if drop is not None:
                    stays = ~drop(a, b, i, j)
                    i, j = i[stays], j[stays]
                left.append(i)
                right.append(j)
        i, j = np.concatenate(left), np.concatenate(right)
        if how == "left":
            alone = np.ones(len(a), bool)
            alone[i] = False
            i, j = np.concatenate((i, np.flatnonzero(alone))), np.concatenate((j, np.full(int(alone.sum()), -1)))
        return i, j

    return find


def take(table: pa.Table, columns: list[str], at: np.ndarray) -> list[pa.Array]:
    """Columns of the rows ``at``; nulls where it is -1."""
    places = pa.array(at, mask=at < 0)
    return [table[c].combine_chunks().take(places) for c in columns]
