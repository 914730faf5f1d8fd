"""Whole runs from files to files: mapping, annotation and primer design in one call each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.functions import sequence as S
from segspark.operators import annotate as A
from segspark.operators import consequence, mapping, off_targets, primer_pairs, primers, quality
from segspark.sources import sinks
from segspark.sources import text as R
from segspark.sources.cache import cached
from segspark.sources.scratch import written

#: Bases of a piece of reference sequence.
PIECE = 4000


@dataclass(frozen=True)
class MapOptions:
    """Options of a mapping run, with their defaults."""

    chrom: str | None = None
    start: int | None = None
    stop: int | None = None
    parents: tuple[str, str] | None = None
    min_qual: float = 100
    filter_flags: str | None = "PASS"
    trust_gatk: bool = False
    dp_max_ratio: float | None = None
    max_hs: float | None = None
    min_segr_pv: float | None = None
    min_ratio: float = 0.45
    max_ratio: float = 0.73
    resolution: int = 100_000
    window_size: int = 5_000_000
    pheno_noise: float = 1e-4
    chrom_size: float | None = None
    opt_eps: bool = False
    opt_recombination: bool = False


def map_scores(snps: DataFrame, n_res: int, n_sus: int, options: MapOptions) -> DataFrame:
    """``chrom, pos, score`` of pooled SNPs: filters, joint counts, ratio filter, likelihoods."""
    o = options
    kept = quality.preprocess(snps, o.chrom, o.start, o.stop, o.min_qual, o.max_hs, o.filter_flags, o.dp_max_ratio, min_p_value=o.min_segr_pv, trust=o.trust_gatk)
    kept = written(kept.filter(quality.allele_ratio(o.min_ratio, o.max_ratio)))
    rates = mapping.recombination_rate(kept) if o.chrom_size is None else kept.sparkSession.createDataFrame([(2.0 / o.chrom_size,)], "rate double")
    if o.opt_eps or o.opt_recombination:
        return mapping.map_score_opt(kept, n_res, n_sus, o.resolution, o.window_size, o.opt_eps, o.opt_recombination, rates=rates)
    return mapping.map_score(kept, n_res, n_sus, o.resolution, o.window_size, o.pheno_noise, rates=rates)


def run_map(spark: SparkSession, source: str, out: str, res: str, sus: str, n_res: int, n_sus: int, options: MapOptions | None = None, cache: str | None = None, recalc: bool = False, force: bool = False) -> None:
    """Scores of a normalised table (pools ``res`` and ``sus`` by their column names) as a folder
    of comma-separated files for each chromosome under ``out``.

    With ``cache`` (a folder) the parsed table is kept there and used again until the source
    changes or ``recalc`` is set."""
    options = options or MapOptions()
    load = lambda: R.read_pooled(spark, source, res, sus, options.parents)
    snps = cached(spark, source, cache, "pooled", {"res": res, "sus": sus, "parents": options.parents}, load, recalc) if cache else load()
    sinks.write_scores(map_scores(snps, n_res, n_sus, options), out, force)


@dataclass(frozen=True)
class AnnotateOptions:
    """Options of an annotation run, with their defaults.  ``alleles``: major, minor or all."""

    chrom: str | None = None
    start: int | None = None
    end: int | None = None
    alleles: str = "all"
    filters: tuple[str, ...] = ()
    mut: bool = False
    alignments: bool = False


def gene_model(spark: SparkSession, gff: str | list[str], config: dict[str, list[str]], o: AnnotateOptions) -> tuple[DataFrame, DataFrame]:
    """Genes (gene, chrom, strand, g_start, g_end) and exons with their offsets, of first isoforms."""
    crop = lambda key: (config.get(key) or [""])[0]
    rows = R.read_gff(spark, gff, o.chrom, o.start, o.end, crop("CROP_CHR_GFF_START"), crop("CROP_CHR_GFF_END"))
    name = lambda tag, cut: R.feature_name(F.col("attributes"), crop(tag), crop(cut))
    coding = config.get("CODING_FEATURE", ["CDS"])
    gene_type = config.get("GENE_FEATURE", ["gene"])[0]
    coding = [c for c in coding if c != gene_type] or coding
    genes = rows.filter(F.col("type") == gene_type).select(name("GENE_TAG", "GENE_SPLITSTRING").alias("gene"), "chrom", "strand", F.col("start").alias("g_start"), F.col("end").alias("g_end")).filter("gene IS NOT NULL").dropDuplicates(["gene"])
    parent = F.try_element_at("attributes", F.lit(crop("CODING_TAG") or "Parent"))
    parts = rows.filter(F.col("type").isin(coding) & consequence.first_isoform(parent, "\\.t?(\\d+)$"))
    parts = parts.select(name("CODING_TAG", "CODING_SPLITSTRING").alias("gene"), "chrom", "strand", F.col("start").alias("e_start"), F.col("end").alias("e_end")).filter("gene IS NOT NULL").distinct()
    return genes, consequence.exon_offsets(parts)


def annotated(spark: SparkSession, source: str | list[str], gff: str | list[str], genome: str | list[str], config: dict[str, list[str]], options: AnnotateOptions | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of :func:`operators.annotate.annotate` for a normalised table, with ``label`` (the alleles
    of the pools); the genes' coding sequences (gene, strand, cds); and the exons."""
    o = options or AnnotateOptions()
    rows = R.read_normalised(spark, source).filter(quality.in_region(o.chrom, o.start, o.end)).withColumn("filter", F.array_join("flags", ";"))
    for test in ([consequence.keep_allele(o.alleles)] if o.alleles != "all" else []) + ([consequence.without_flags(list(o.filters))] if o.filters else []):
        rows = rows.filter(test)
    labelled = consequence.explode_alternatives(rows.withColumn("label", F.coalesce(consequence.sample_label(), F.lit("na")))).filter("alt <> ref")
    kinds = consequence.variant_kind(labelled.select("chrom", "pos", "ref", "alt", "label", "filter")).withColumn("len", F.col("len").cast("int"))
    kinds = written(kinds.withColumn("vid", F.concat_ws(":", "chrom", "pos", "ref", "alt", "label", "filter")).distinct())
    genes, exons = gene_model(spark, gff, config, o)
    chunks = written(R.read_fasta(spark, genome, PIECE))
    span = lambda df, key, a, b: R.subsequences(df.select(key, "chrom", F.col(a).alias("start"), F.col(b).alias("end")), chunks, PIECE, key)
    whole = span(genes, "gene", "g_start", "g_end").select("gene", F.upper("seq").alias("seq"))
    placed = exons.withColumn("part", F.concat_ws(":", "gene", "e_start"))
    cut = placed.join(span(placed, "part", "e_start", "e_end").select("part", F.upper("seq").alias("seq")), "part")
    cds = written(consequence.coding_sequence(cut))
    strands = exons.groupBy("gene").agg(F.first("strand").alias("strand"))
    return A.annotate(kinds, genes, exons, cds, sequences=whole), cds.join(strands, "gene"), exons


def alignments(rows: DataFrame, cds: DataFrame) -> DataFrame:
    """Aligned genes (gene, ref, alt, edited) of annotated rows that lie in coding sequences."""
    plus, n, kind = F.col("strand") == "+", F.col("cds_len"), F.col("vartype")
    single = F.when(plus, F.col("cds_from")).when(kind == "S", n - F.col("cds_from") + 1).otherwise(n - F.col("cds_from"))
    left = F.when(kind != "D", single).when(plus, F.col("cds_from")).otherwise(n - F.col("cds_to") + 1)
    right = F.when(kind != "D", single).when(plus, F.col("cds_to")).otherwise(n - F.col("cds_from") + 1)
    inserted = F.when(kind == "S", F.col("alt")).when(kind == "I", F.col("seq"))
    edits = rows.filter("cds_from IS NOT NULL").select("gene", F.col("vartype"), left.cast("int").alias("cds_left"), right.cast("int").alias("cds_right"), inserted.alias("seq"))
    return consequence.gene_alignment(cds, edits)


def run_annotate(spark: SparkSession, source: str, gff: str, genome: str, config: list[str], out: str, options: AnnotateOptions | None = None, force: bool = False) -> None:
    """The annotated table (or mutation lines) of a normalised table under ``out``, with its
    alignments under ``out``-genes if they are asked for."""
    o = options or AnnotateOptions()
    rows, cds, _ = annotated(spark, source, gff, genome, R.gff_config(config), o)
    rows = written(rows) if o.alignments else rows
    line: Column = A.mut_line(F.col("label")) if o.mut else A.annotated_line(F.col("label"), ("filter",))
    sinks.write_lines(rows.select(line.alias("line")), out, [A.MUT_HEADER] if o.mut else [], force)
    if o.alignments:
        found = alignments(rows, cds).filter("edited > 0").orderBy("gene")
        sinks.write_lines(found.select(consequence.alignment_lines().alias("line")), f"{out}-genes", [], force)


@dataclass(frozen=True)
class DesignOptions:
    """Options of a primer design, with their defaults."""

    legal: tuple[str, ...] = ("PASS",)
    max_secondary_indel: int = 5
    restriction: str = ""
    layout: primers.Layout = primers.Layout()
    settings: primer_pairs.PickSettings = primer_pairs.PickSettings()
    seed: int = 12
    mismatches: int = 3


def designs(spark: SparkSession, source: str | list[str], genome: str | list[str], options: DesignOptions | None = None) -> DataFrame:
    """Columns of a primer table for the SNPs of a normalised table: of each, the best pair of the
    forward template, else of the reverse one, that amplifies one product in the genome."""
    o = options or DesignOptions()
    flank = o.layout.flank
    rows = R.read_normalised(spark, source)
    rows = written(primers.roles(rows.withColumn("vid", F.concat_ws(":", "chrom", "pos", "ref", "alt")), list(o.legal), o.max_secondary_indel).dropDuplicates(["vid"]))
    chunks = written(R.read_fasta(spark, genome, PIECE))
    others = rows.filter("role = 'secondary'").select(F.col("vid").alias("o_id"), "chrom", F.col("pos").alias("o_pos"), F.col("ref").alias("o_ref"), F.col("alt").alias("o_alt"))
    made = primers.templates(rows.filter("role = 'primary'"), others, chunks, PIECE, flank).filter(F.length("template") == 2 * flank + 1)
    ways = made.withColumn("direction", F.explode(F.array(F.lit("fwd"), F.lit("rev"))))
    ways = ways.withColumn("template", F.when(F.col("direction") == "fwd", F.upper("template")).otherwise(S.revcomp_iupac(F.upper("template"))))
    picked = written(primer_pairs.pick_pairs(ways, o.layout, o.settings).filter("primer_left IS NOT NULL"))
    parts = _windows(chunks, o.settings.max_size)
    named = picked.withColumn("_vid", F.concat_ws("/", "vid", "direction"))
    found = off_targets.specificity(named.select(F.col("_vid").alias("vid"), "primer_left", "primer_right"), parts, o.layout.product_max, o.seed, o.mismatches)
    fine = named.join(found.filter("products = 1").select(F.col("vid").alias("_vid")), "_vid", "left_semi")
    done = fine.select("vid", "chrom", "pos", "ref", "alt", "major", "minor", "qual", "flags", "type", "segr_major", "segr_minor", "direction", "primer_left", "primer_right", *primers.product(flank, o.restriction))
    return primers.best_direction(done.filter("direction = 'fwd'"), done.filter("direction = 'rev'"))


def _windows(chunks: DataFrame, flank: int) -> DataFrame:
    """Windows of :func:`off_targets.windows` from chunks of ``PIECE`` bases: each with the end of the
    chunk before it and the beginning of the next."""
    upper = chunks.select("chrom", "chunk", F.upper("seq").alias("seq"))
    ahead = upper.select("chrom", (F.col("chunk") + 1).alias("chunk"), F.expr(f"right(seq, {flank})").alias("_a"))
    behind = upper.select("chrom", (F.col("chunk") - 1).alias("chunk"), F.substr("seq", F.lit(1), F.lit(flank)).alias("_b"))
    rows = upper.join(ahead, ["chrom", "chunk"], "left").join(behind, ["chrom", "chunk"], "left")
    first, last = F.coalesce("_a", F.lit("")), F.coalesce("_b", F.lit(""))
    return rows.select("chrom", (F.col("chunk") * PIECE + 1).alias("start"), F.length(first).alias("lead"), F.length("seq").alias("core"), F.concat(first, "seq", last).alias("seq"))


def run_design(spark: SparkSession, source: str, genome: str, out: str, options: DesignOptions | None = None, force: bool = False) -> None:
    """The primer table of a normalised table under ``out``."""
    rows = designs(spark, source, genome, options)
    segr = F.when(F.col("segr_major").isNotNull(), F.concat_ws(",", "segr_major", "segr_minor"))
    shown = rows.select("*", F.col("vid").alias("id"), F.array_join("flags", ";").alias("filter"), segr.alias("segr"))
    sinks.write_lines(shown.select(sinks.primer_line().alias("line")), out, ["#" + "\t".join(R.PRIMER_COLUMNS)], force)
