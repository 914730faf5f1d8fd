"""Aggregates over bins of positions or of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def position_bins(rows: DataFrame, values: list[str], window: int, step: int, mean: bool = False, key: str = "chrom", pos: str = "pos") -> DataFrame:
    """Sums or means of ``values`` in the overlapping bins [i * step, i * step + window) whose
    start lies before the largest position.  Empty bins are absent; ``bin_pos`` is the
    smallest position in a bin.

    Each row lists the bins it falls into, so there is one aggregation and no join."""
    top = rows.groupBy(key).agg(F.max(pos).alias("_top"))
    first = F.greatest(F.lit(0), F.floor((F.col(pos) - window) / step) + 1)
    last = F.least(F.floor(F.col(pos) / step), F.ceil(F.col("_top") / step) - 1)
    spread = rows.join(top, key).withColumn("_lo", first).withColumn("_hi", last).filter("_lo <= _hi").withColumn("bin", F.explode(F.sequence("_lo", "_hi")))
    over = F.avg if mean else F.sum
    return spread.groupBy(key, "bin").agg(F.min(pos).alias("bin_pos"), F.count("*").alias("n"), *(over(v).alias(v) for v in values))


def row_bins(rows: DataFrame, values: list[str], size: int, key: str = "chrom", pos: str = "pos", ties: tuple[str, ...] = ()) -> DataFrame:
    """Sums of ``values`` and the mean position of each ``size`` consecutive rows of a key,
    in order of position; the last bin can be shorter.

    Numbering is per stretch of positions, shifted by the counts before it, so that no
    single task sorts a whole chromosome."""
    rows = numbered(rows, key, pos, ties)
    return rows.groupBy(key, F.floor(F.col("_i") / size).alias("bin")).agg(F.avg(pos).alias("bin_pos"), F.count("*").alias("n"), *(F.sum(v).alias(v) for v in values))


def numbered(rows: DataFrame, key: str = "chrom", pos: str = "pos", ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``_i``: the number of each row of a key from 0, in order of position."""
    stretch = F.floor(F.col(pos) / F.lit(STRETCH))
    counts = rows.groupBy(key, stretch.alias("_s")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(key, "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy(key, "_s").orderBy(pos, *ties)
    found = rows.withColumn("_s", stretch).withColumn("_i", F.row_number().over(order) - 1).join(counts, [key, "_s"])
    return found.withColumn("_i", F.col("_i") + F.col("_before")).drop("_s", "_before")


def row_windows(rows: DataFrame, values: list[str], reach: int, key: str = "chrom", pos: str = "pos", ties: tuple[str, ...] = (), block: int = 10_000) -> DataFrame:
    """Adds ``window_<value>``: sums over the ``reach`` rows before and after each row and itself.

    Blocks of rows get ``reach`` rows of their neighbours, so windows stay within blocks."""
    i = F.col("_i")
    blocks = numbered(rows, key, pos, ties).withColumn("_b", F.explode(F.sequence(F.floor(F.greatest(i - reach, F.lit(0)) / block), F.floor((i + reach) / block))))
    near = Window.partitionBy(key, "_b").orderBy("_i").rowsBetween(-reach, reach)
    summed = blocks.withColumns({f"window_{v}": F.sum(v).over(near) for v in values})
    return summed.filter(F.col("_b") == F.floor(i / block)).drop("_i", "_b")


#: Base pairs of one stretch in which rows are numbered.
STRETCH = 1_000_000


def call_shares(rows: DataFrame, homozygous: Column, window: int, step: int) -> DataFrame:
    """Share of homozygous and heterozygous rows in each bin."""
    flagged = rows.withColumn("_hom", homozygous.cast("int"))
    bins = position_bins(flagged, ["_hom"], window, step)
    share = F.col("_hom") / F.col("n")
    return bins.select("chrom", "bin", "bin_pos", "n", share.alias("hom"), (1 - share).alias("het"))


def expected_window(rows: DataFrame, samples: int) -> DataFrame:
    """Window in which one crossover is expected among all samples, for each key."""
    return rows.groupBy("chrom").agg(((F.max("pos") - F.min("pos")) / (2 * samples)).alias("window"))
