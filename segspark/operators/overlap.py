"""Interval joins on bins.

Both sides list the bins they touch and meet in an equi join on chromosome and bin; a
pair counts only in the first bin that both touch, so nothing appears twice.  Bins keep
one chromosome from being one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BIN = 20_000
#: Features that a plan may broadcast; of more of them it would only know the bytes they are read from.
BROADCAST_FEATURES = 1 << 18


def _binned(rows: DataFrame, start, end, size: int) -> DataFrame:
    rows = rows.withColumn("_first", F.floor(start / size)).withColumn("_last", F.floor(end / size))
    return rows.filter("_first <= _last").withColumn("_bin", F.explode(F.sequence("_first", "_last")))


def overlap_join(left: DataFrame, right: DataFrame, keep_unmatched: str | None = None, size: int = BIN) -> DataFrame:
    """Pairs of ``left`` (chrom, start, end, ...) and ``right`` (chrom, r_start, r_end, ...)
    that share a base.  ``keep_unmatched``: a column that tells left rows apart; those
    without a partner are kept with nulls."""
    a = _binned(left, F.col("start"), F.col("end"), size)
    b = _binned(right, F.col("r_start"), F.col("r_end"), size).withColumnRenamed("_first", "_r_first").withColumnRenamed("chrom", "_r_chrom").withColumnRenamed("_bin", "_r_bin").drop("_last")
    met = a.join(b, (F.col("chrom") == F.col("_r_chrom")) & (F.col("_bin") == F.col("_r_bin")) & (F.col("start") <= F.col("r_end")) & (F.col("end") >= F.col("r_start")) & (F.col("_bin") == F.greatest("_first", "_r_first")))
    met = met.drop("_first", "_last", "_bin", "_r_first", "_r_bin", "_r_chrom")
    if keep_unmatched is None:
        return met
    others = [c for c in met.columns if c not in left.columns]
    return left.join(met.select(keep_unmatched, *others), keep_unmatched, "left")


def variant_interval(rows: DataFrame) -> DataFrame:
    """Adds ``start, end`` of a variant (``vartype`` S, I or D): an insertion lies between
    its base and the next, and touches a feature only if both are inside or it ends there."""
    length = F.when(F.col("vartype") == "D", F.col("pos") + F.col("len") - 1).otherwise(F.col("pos"))
    return rows.withColumn("start", F.col("pos")).withColumn("end", length)


def features_of(variants: DataFrame, features: DataFrame, size: int = BIN) -> DataFrame:
    """Variants (vid, chrom, pos, vartype, len) with each feature (f_id, chrom, f_start, f_end,
    ...) they hit; without one the feature is null (intergenic).  Insertions must begin
    before the last base; ``hit_start, hit_end`` is the stretch inside the feature."""
    right = features.withColumnRenamed("f_start", "r_start").withColumnRenamed("f_end", "r_end")
    right = right if features.count() <= BROADCAST_FEATURES else right.hint("merge")
    met = overlap_join(variant_interval(variants), right, size=size)
    met = met.filter((F.col("vartype") != "I") | (F.col("pos") < F.col("r_end")))
    met = met.withColumn("hit_start", F.greatest("start", "r_start")).withColumn("hit_end", F.least("end", "r_end"))
    met = met.withColumnRenamed("r_start", "f_start").withColumnRenamed("r_end", "f_end")
    others = [c for c in met.columns if c not in variants.columns and c not in ("start", "end")]
    return variants.join(met.select("vid", *others), "vid", "left")


def neighbours(rows: DataFrame, others: DataFrame, flank: int) -> DataFrame:
    """For each row (vid, chrom, pos) the ``others`` (o_id, chrom, o_pos) within ``flank``, itself
    left out: one row for each pair."""
    left = rows.withColumn("start", F.col("pos") - flank).withColumn("end", F.col("pos") + flank)
    right = others.withColumn("r_start", F.col("o_pos")).withColumn("r_end", F.col("o_pos"))
    return overlap_join(left, right, size=max(256, 2 * flank)).filter("vid <> o_id").drop("start", "end", "r_start", "r_end")
