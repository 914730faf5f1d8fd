"""Row filters of pooled SNPs.

Input columns: ``chrom, pos, alleles_res, alleles_sus (ref, alt), qual, hapsc, flags
(array), res_major, res_minor, sus_major, sus_minor`` and, where used, ``geno_res,
geno_sus, parent1, parent2``.  Filters are plain predicates, so those on stored columns
reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOMOZYGOUS = ("0|0", "1|1", "1/1", "0/0")


def coverage(pool: str) -> Column:
    return F.col(f"{pool}_major") + F.col(f"{pool}_minor")


def in_region(chrom: str | None = None, start: int | None = None, stop: int | None = None) -> Column:
    tests = [t for given, t in ((chrom, F.col("chrom") == chrom), (start, F.col("pos") >= start), (stop, F.col("pos") <= stop)) if given is not None]
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def no_missing_allele() -> Column:
    """Some allele of each pool is known."""
    return F.exists("alleles_res", lambda a: a != "N") & F.exists("alleles_sus", lambda a: a != "N")


def no_dash() -> Column:
    return F.forall("alleles_res", lambda a: a != "-") & F.forall("alleles_sus", lambda a: a != "-")


def same_allele(index: int) -> Column:
    """Both pools have the same allele at 0-based ``index`` (0: major)."""
    return F.get("alleles_res", F.lit(index)) == F.get("alleles_sus", F.lit(index))


def legal_flags(legal: str) -> Column:
    """Every flag is one of the comma-separated ones, whose case doesn't count."""
    return F.size(F.array_except("flags", F.array(*map(F.lit, legal.upper().split(","))))) == 0


def parents_segregate() -> Column:
    a, b = F.col("parent1"), F.col("parent2")
    return ((a == "0|0") & (b == "1|1")) | ((a == "1|1") & (b == "0|0"))


def medians(snps: DataFrame) -> DataFrame:
    """One row: the exact median coverage of both pools."""
    return snps.agg(F.median(coverage("res")).alias("median_res"), F.median(coverage("sus")).alias("median_sus"))


def coverage_band(snps: DataFrame, ratio: float, of: DataFrame | None = None) -> DataFrame:
    """SNPs whose coverage lies strictly within ``ratio`` of the median of ``of`` (the SNPs
    before any region was cut out) in both pools."""
    row = F.broadcast(medians(snps if of is None else of))  # one row
    near = lambda pool: (coverage(pool) > F.col(f"median_{pool}") * (1 - ratio)) & (coverage(pool) < F.col(f"median_{pool}") * (1 + ratio))
    return snps.crossJoin(row).filter(near("res") & near("sus")).select(*snps.columns)


def library_factors(snps: DataFrame) -> DataFrame:
    """One row ``res_sum, sus_sum, factor``; counts of res times the factor match those of sus."""
    sums = snps.agg(F.sum(coverage("res").cast("long")).alias("res_sum"), F.sum(coverage("sus").cast("long")).alias("sus_sum"))
    return sums.withColumn("factor", F.try_divide(F.col("res_sum").cast("double"), F.col("sus_sum")))


def with_counts_both(snps: DataFrame) -> DataFrame:
    """Adds ``both_major, both_minor``: res times the library factor, plus sus."""
    row = F.broadcast(library_factors(snps).select("factor"))  # one row
    both = lambda x: F.col("factor") * F.col(f"res_{x}") + F.col(f"sus_{x}")
    return snps.crossJoin(row).withColumn("both_major", both("major")).withColumn("both_minor", both("minor")).drop("factor")


def allele_ratio(low: float = 0.45, high: float = 0.73) -> Column:
    share = F.try_divide(F.col("both_major"), F.col("both_major") + F.col("both_minor"))
    return (share > low) & (share < high)


def trust_genotypes(snps: DataFrame) -> DataFrame:
    """Minor counts of pools that were called homozygous become 0."""
    zero = lambda pool: F.when(F.col(f"geno_{pool}").isin(*HOMOZYGOUS), F.lit(0)).otherwise(F.col(f"{pool}_minor"))
    return snps.withColumn("res_minor", zero("res")).withColumn("sus_minor", zero("sus"))


def depth_and_parents(min_depth: int = 8, max_depth: int = 300) -> Column:
    """The filter of the older allele table: pool depths within bounds, both parents
    homozygous (no second allele) and deep enough."""
    pool = lambda x: (F.col(f"{x}_n1") + F.col(f"{x}_n2") > min_depth) & (F.col(f"{x}_n1") + F.col(f"{x}_n2") < max_depth)
    parent = lambda x: (F.col(f"{x}_a2") == "N") & (F.col(f"{x}_n1") + F.col(f"{x}_n2") > min_depth)
    return pool("sus") & pool("res") & parent("um") & parent("tn1")


def flip_by_parents(rows: DataFrame) -> DataFrame:
    """Rows of the older table with each pool's alleles in the order of the parents: they, and
    their counts, are exchanged if the second is that of TN1 or the first that of UM."""
    out = rows
    for p in ("res", "sus"):
        turn = (F.col(f"{p}_a2") == F.col("tn1_a1")) | (F.col(f"{p}_a1") == F.col("um_a1"))
        pick = lambda x, a, b, turn=turn, p=p: F.when(turn, F.col(f"{p}_{x}{a}")).otherwise(F.col(f"{p}_{x}{b}"))
        out = out.withColumns({f"{p}_{x}{i}": pick(x, 3 - i, i) for x in ("a", "n") for i in (1, 2)})
    return out


def retained(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: how many SNPs were ``retained`` and the ``total``."""
    return kept.agg(F.count("*").alias("retained")).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row each


def preprocess(
    snps: DataFrame,
    chrom: str | None = None,
    start: int | None = None,
    stop: int | None = None,
    min_qual: float = 0,
    max_hapsc: float | None = 1.0,
    legal: str | None = "PASS",
    ratio: float | None = 0.5,
    match_major: bool = True,
    match_minor: bool = False,
    min_p_value: float | None = None,
    trust: bool = False,
) -> DataFrame:
    """All filters in their order: medians of everything, region, row filters, joint counts,
    segregation test, genotypes.  Missing quality or score drops a row where it is asked for."""
    from segspark.functions.stats import binomial_p_value

    keep = in_region(chrom, start, stop)
    if {"alleles_res", "alleles_sus"} <= set(snps.columns):
        keep = keep & no_missing_allele() & no_dash()
        keep = keep & same_allele(0) if match_major else keep
        keep = keep & same_allele(1) if match_minor else keep
    keep = keep & (F.col("qual") >= min_qual) if min_qual else keep
    keep = keep & (F.col("hapsc") <= max_hapsc) if max_hapsc else keep
    keep = keep & legal_flags(legal) if legal else keep
    keep = keep & parents_segregate() if {"parent1", "parent2"} <= set(snps.columns) else keep
    kept = snps.filter(keep)
    kept = coverage_band(kept, ratio, of=snps) if ratio is not None else kept
    kept = with_counts_both(kept)
    if min_p_value is not None:
        major, total = F.round("both_major").cast("long"), F.round(F.col("both_major") + F.col("both_minor")).cast("long")
        kept = kept.filter(binomial_p_value(major, total) > min_p_value)
    return trust_genotypes(kept) if trust else kept
