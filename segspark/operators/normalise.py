"""Normalisation of variant calls of two pools: phase alleles, count, flag.

Input is what ``sources.text.read_vcf`` returns, or any rows with ``ref, alt, info,
filter, format, samples``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segspark.sources.text import counts

#: Order of the tags of a sample.
TAGS = ("GT", "AD", "DP", "GQ", "PL")


@dataclass(frozen=True)
class Design:
    """Names of the phasing pool, the other pool and both parents, if there are any."""

    phasing: str
    other: str
    parents: tuple[str, ...] = ()
    swap_likelihoods: bool = True  # reverse PL, too, where alleles are switched
    likelihood: str = "PL"
    passed: str = "PASS"

    @property
    def samples(self) -> tuple[str, ...]:
        return (self.phasing, self.other, *self.parents)


def sample_tags(name: str) -> Column:
    """Tags of a sample, null if it has none."""
    return F.get(F.filter("samples", lambda s: s["name"] == name), F.lit(0))["tags"]


def allele_depths(tags: Column) -> Column:
    return counts(F.try_element_at(tags, F.lit("AD")))


def is_homozygous(gt: Column) -> Column:
    return F.substr(gt, F.lit(1), F.lit(1)) == F.substr(gt, F.lit(3), F.lit(1))


def variant_type(ref: Column, alt: Column) -> Column:
    """``multi-allelic``, ``indel``, ``SNP`` or ``.`` of a reference and an array of alternatives."""
    first = F.get(alt, F.lit(0))
    return F.when(F.size(alt) > 1, "multi-allelic").when((F.length(ref) > 1) | (F.length(first) > 1), "indel").when(ref != first, "SNP").otherwise(".")


def switched(depths: Column) -> Column:
    """Whether the second allele is the commoner one in the phasing pool."""
    return F.coalesce(F.get(depths, F.lit(0)) < F.get(depths, F.lit(1)), F.lit(False))


def switch_genotype(gt: Column) -> Column:
    """0 becomes 1, all else 0; unphased heterozygous calls stay."""
    other = lambda i: F.when(F.substr(gt, F.lit(i), F.lit(1)) == "0", "1").otherwise("0")
    sep = F.substr(gt, F.lit(2), F.lit(1))
    return F.when(~is_homozygous(gt) & (sep == "/"), gt).otherwise(F.concat(other(1), sep, other(3)))


def check_calls(calls: DataFrame, design: Design) -> DataFrame:
    """Rows as they are; a FORMAT without a required tag is an error, as is any number of
    samples but two or four."""
    if len(design.samples) not in (2, 4):
        raise ValueError("two pools, and both parents or none")
    need = F.array(*(F.lit(t if t != "PL" else design.likelihood) for t in TAGS))
    lacking = F.array_except(need, F.col("format"))
    row = F.concat_ws("@", "chrom", "pos")
    return calls.filter(F.when(F.size(lacking) == 0, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("FORMAT lacks "), F.array_join(lacking, " "), F.lit(" at "), row)).cast("boolean")))


def normalise(calls: DataFrame, design: Design) -> DataFrame:
    """``chrom, pos, ref, alt, major, minor, qual, filter, type, segr_major, segr_minor,
    hapsc, format`` and a column of ``:``-joined tags for each sample, named as the sample.

    All is per row: one narrow stage."""
    tags = {s: sample_tags(s) for s in design.samples}
    prepared = calls.withColumns({f"_t{i}": tags[s] for i, s in enumerate(design.samples)})
    t = {s: F.col(f"_t{i}") for i, s in enumerate(design.samples)}
    ad = {s: allele_depths(t[s]) for s in design.samples}
    gt = {s: F.try_element_at(t[s], F.lit("GT")) for s in design.samples}
    kind = variant_type(F.col("ref"), F.col("alt"))
    prepared = prepared.withColumn("type", kind).withColumn("_multi", F.size("alt") > 1).withColumn("_switch", switched(ad[design.phasing]) & ~F.col("_multi"))
    switch, multi = F.col("_switch"), F.col("_multi")

    def value(s: str, name: str) -> Column:
        raw = F.try_element_at(t[s], F.lit(name))
        turned = {"GT": switch_genotype(raw), "AD": F.array_join(F.reverse(F.split(raw, ",")), ","), design.likelihood: F.array_join(F.reverse(F.split(raw, ",")), ",") if design.swap_likelihoods else raw}.get(name, raw)
        return F.coalesce(F.when(switch, turned).otherwise(raw), F.lit("na"))

    names = [x if x != "PL" else design.likelihood for x in TAGS]
    text = {s: F.concat_ws(":", *(value(s, n) for n in names)) for s in design.samples}
    pools = (design.phasing, design.other)
    known = F.lit(True)
    for s in pools:
        known = known & (F.size(ad[s]) >= 2)
    pair = lambda i: sum(F.coalesce(F.get(ad[s], F.when(switch, F.lit(1 - i)).otherwise(F.lit(i))), F.lit(0)) for s in pools)
    flags = [
        F.when(~F.map_contains_key("info", F.lit("SB")), "NoSBtag"),
        F.when(is_homozygous(gt[design.other]), "NonPhasingPoolHomozygous"),
    ]
    if design.parents:
        a, b = (gt[s] for s in design.parents)
        flags.append(F.when(~is_homozygous(a) | ~is_homozygous(b), "ParentHeterozygous"))
        flags.append(F.when(is_homozygous(a) & is_homozygous(b) & (F.substr(a, F.lit(1), F.lit(1)) == F.substr(b, F.lit(1), F.lit(1))), "ParentsNotSegr"))
    added = F.array_compact(F.array(*flags))
    kept = F.when(F.size(added) > 0, F.filter("filter", lambda x: x != design.passed)).otherwise(F.col("filter"))
    first = F.get("alt", F.lit(0))
    return prepared.select(
        "chrom",
        "pos",
        "ref",
        "alt",
        F.when(multi, None).when(switch, first).otherwise(F.col("ref")).alias("major"),
        F.when(multi, None).when(switch, F.col("ref")).otherwise(first).alias("minor"),
        "qual",
        F.concat(kept, added).alias("filter"),
        "type",
        F.when(known, pair(0)).alias("segr_major"),
        F.when(known, pair(1)).alias("segr_minor"),
        F.try_element_at("info", F.lit("HaplotypeScore")).try_cast("double").alias("hapsc"),
        F.array(*map(F.lit, names)).alias("format"),
        *(text[s].alias(s) for s in design.samples),
    )


def pcr_table(calls: DataFrame, samples: list[str]) -> DataFrame:
    """Allele depths and shares of depth of each sample; shares are null without depth."""
    columns = ["chrom", "pos", "ref", F.array_join("alt", ",").alias("alt")]
    for s in samples:
        ad, dp = allele_depths(sample_tags(s)), F.try_element_at(sample_tags(s), F.lit("DP")).try_cast("int")
        a, b = F.get(ad, F.lit(0)), F.get(ad, F.lit(1))
        columns += [a.alias(f"{s}_major"), b.alias(f"{s}_minor"), dp.alias(f"{s}_dp"), F.try_divide(a.cast("double"), dp).alias(f"{s}_major_share"), F.try_divide(b.cast("double"), dp).alias(f"{s}_minor_share")]
    return calls.select(*columns)


def average_depth(depth: str) -> Column:
    """Mean of the depths above 0."""
    return F.try_divide(F.sum(depth).cast("double"), F.count_if(F.col(depth) > 0))
