"""Annotation of variants from one end to the other: genes, exons, splice sites, effects,
and the lines that are written of them.

Variants meet genes in one sweep over the genome.  A gene travels with its exons and its
sequences once to each part of the genome that it reaches into; there the bases that a
variant needs are cut out of them, so no variant carries a gene's sequence through a
shuffle.  All effects are columns of the row that comes out."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from segspark.operators import consequence as C
from segspark.operators.overlap import variant_interval
from segspark.operators.sweep import pairs, sweep_join, take

EFFECTS = ("cds_len", "cds_from", "cds_to", "codon_pos", "kind", "ref_aa", "new_aa", "codon", "codon_alt", "degeneracy", "new_stop", "lost_stop", "lost_start", "splicechange", "frameshift")
_GENE = "gene, strand, g_start, g_end, cds_len".split(", ")
_PLACE = "hits array<struct<e_start:long,e_end:long,exon_off:long>>, earlier boolean, later boolean, prev_end long, next_start long, raw_codon string, cds string, raw_motif string, motif_place int"


def gene_models(genes: DataFrame, exons: DataFrame, cds: DataFrame, sequences: DataFrame | None = None) -> DataFrame:
    """One row for each gene: ``exons`` in order, ``cds_len, cds``, and ``seq``, its bases from
    the first to the last, null without ``sequences`` (gene, seq).  Sequences are long whatever
    the tables they are made of, so no side of these joins is broadcast."""
    listed = exons.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("e_start", "e_end", "exon_off"))).alias("exons"), F.max("cds_len").cast("int").alias("cds_len"))
    rows = genes.select("gene", "chrom", "strand", "g_start", "g_end").join(listed.hint("merge"), "gene", "left").join(cds.select("gene", "cds").hint("merge"), "gene", "left")
    if sequences is None:
        return rows.withColumn("seq", F.lit(None).cast("string"))
    return rows.join(sequences.select("gene", "seq").hint("merge"), "gene", "left")


def _beyond(a: pa.Table, b: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Insertions behind the last base of a gene, which are not in it."""
    insertion = a["vartype"].to_numpy() == "I"
    return insertion[i] & (a["start"].to_numpy()[i] >= b["r_end"].to_numpy()[j])


def _placed(a: pa.Table, b: pa.Table, i: np.ndarray, j: np.ndarray, schema: pa.Schema) -> list[pa.Array]:
    """For pairs of variants and genes: the exons that are hit and whether there are others
    before and behind them, or the ends of the exons around; the codon of a SNP in an exon, the
    coding sequence for an indel that touches one, and the bases of the splice site that a SNP
    hits with its place there, all on the plus strand."""
    out: list[list] = [[None] * len(i) for _ in schema]
    kinds, starts, stops = a["vartype"].to_pylist(), a["start"].to_pylist(), a["end"].to_pylist()
    models = [x or [] for x in b["exons"].to_pylist()]
    coding, whole, begins = b["cds"].to_pylist(), b["seq"].to_pylist(), b["g_start"].to_pylist()
    firsts, lasts = ([[e[c] for e in x] for x in models] for c in ("e_start", "e_end"))
    for at, (v, g) in enumerate(zip(i.tolist(), j.tolist())):
        if g < 0 or not models[g]:
            continue
        pos, end, kind, exons = starts[v], stops[v], kinds[v], models[g]
        low, high = bisect_left(lasts[g], pos), bisect_right(firsts[g], end)
        if low < high and (kind != "I" or pos < lasts[g][low]):
            out[0][at], out[1][at], out[2][at] = exons[low:high], low > 0, high < len(exons)
            if kind != "S":
                out[6][at] = coding[g]
            elif coding[g] is not None:
                c = (exons[low]["exon_off"] + pos - exons[low]["e_start"]) // 3 * 3
                out[5][at] = coding[g][c : c + 3]
        elif low == high and 0 < low < len(exons) and kind != "D":
            before, after = lasts[g][low - 1], firsts[g][low]
            out[3][at], out[4][at] = before, after
            front = before + 1 if pos <= before + 2 else after - 2
            if kind == "S" and whole[g] is not None and (pos <= before + 2 or pos >= after - 2):
                out[7][at], out[8][at] = whole[g][front - begins[g] : front - begins[g] + 2], pos - front + 1
    return [pa.array(x, f.type) for x, f in zip(out, schema)]


def in_genes(variants: DataFrame, models: DataFrame) -> DataFrame:
    """``variants`` (vid, chrom, pos, alt, vartype, len, seq) with each gene of ``models`` that they
    hit, null between genes, and the bases of it that they need."""
    left = variant_interval(variants)
    right = models.withColumn("r_start", F.col("g_start")).withColumn("r_end", F.col("g_end"))
    schema = StructType([*left.schema.fields, *(StructField(c, models.schema[c].dataType) for c in _GENE), *(place := StructType.fromDDL(_PLACE)).fields])
    kinds = to_arrow_schema(place)
    own, find = left.columns, pairs("left", _beyond)

    def merge(a: pa.Table, b: pa.Table) -> pa.Table:
        i, j = find(a, b)
        return pa.table([*take(a, own, i), *take(b, _GENE, j), *_placed(a, b, i, j, kinds)], names=[f.name for f in schema.fields])

    return sweep_join(left, right, "gene", merge, schema)


def _deletion(pos: Column, end: Column, coding: str) -> dict[str, Column]:
    """What a deletion takes of the exons it touches: coding bases, regions, splice sites."""
    hits, first, last = F.col("hits"), F.get("hits", F.lit(0)), F.get("hits", F.size("hits") - 1)
    from_, to = (lambda x: F.greatest(pos, x["e_start"])), (lambda x: F.least(end, x["e_end"]))

    def part(x: Column, i: Column) -> Column:
        gap = from_(x) - to(F.get(hits, i - 1)) - 1
        own = F.concat(F.lit(coding + ","), to(x) - from_(x) + 1)
        return F.when((i > 0) & (gap > 0), F.concat(F.lit("intronic/noncoding,"), gap, F.lit("-"), own)).otherwise(own)

    gone = F.col("vartype") == "D"
    return {
        "cds_left": F.when(gone, first["exon_off"] + from_(first) - first["e_start"] + 1).cast("int"),
        "cds_right": F.when(gone, last["exon_off"] + to(last) - last["e_start"] + 1).cast("int"),
        "_over": F.when(gone, (F.size(hits) > 1) | ((end > last["e_end"]) & F.col("later")) | ((pos < first["e_start"]) & F.col("earlier"))),
        "_regions": F.when(gone, F.array_join(F.transform(hits, part), "-")),
    }


def annotate(variants: DataFrame, genes: DataFrame, exons: DataFrame, cds: DataFrame, coding: str = "CDS", sequences: DataFrame | None = None) -> DataFrame:
    """``variants`` with each gene (chrom, gene, strand, g_start, g_end) they hit, null between
    genes: ``stype`` (where in the gene), ``gene_pos`` on its strand, and EFFECTS.

    One row for each variant and gene.  ``exons`` have exon_offsets and lie in their genes;
    ``cds`` are the coding sequences (gene, cds).  With ``sequences`` (gene, seq) SNPs in splice
    sites get the site's two bases as ``codon`` and their place as ``codon_pos``.  ``variants``
    are read twice and must be the same rows each time."""
    rows = in_genes(variants, gene_models(genes, exons, cds, sequences))
    pos, end, plus = F.col("pos"), F.col("end"), F.col("strand") == "+"
    is_a = lambda kind: F.col("vartype") == kind
    rows = rows.withColumns(_deletion(pos, end, coding)).withColumn("_hit", F.when(~is_a("D"), F.get("hits", F.lit(0))))
    rows = rows.withColumns({"e_end": F.col("_hit.e_end"), "cds_pos": (F.col("_hit.exon_off") + pos - F.col("_hit.e_start") + 1).cast("int")})
    splice = C.splice_site()
    motif, motif_place = C.splice_motif(F.col("raw_motif"), F.col("motif_place"))

    # The effects of each kind in turn, packed and put aside.
    def packed(df: DataFrame, name: str, columns: tuple[str, ...], back: list[str]) -> DataFrame:
        return df.select(*back, F.struct(*columns).alias(name))

    base = rows.columns
    rows = packed(C.snp_consequence(rows, F.col("raw_codon")), "_s", ("codon", "codon_pos", "codon_alt", "ref_aa", "new_aa", "degeneracy", "kind", "new_stop", "lost_stop", "lost_start"), base)
    rows = packed(C.insertion_effects(rows), "_i", ("frameshift", "splicechange", "lost_start", "new_stop", "lost_stop"), [*base, "_s"])
    rows = packed(C.deletion_effects(rows), "_d", ("frameshift", "lost_start", "new_stop", "lost_stop"), [*base, "_s", "_i"])
    left, right, n = F.col("cds_left"), F.col("cds_right"), F.col("cds_len")
    in_exon = F.col("hits").isNotNull()
    rows = rows.withColumns({"_coding": in_exon, "_splice": F.coalesce(splice, F.lit(False))})
    of = lambda **kinds: F.when(F.col("_coding"), F.coalesce(*(F.when(is_a(k.upper()), c) for k, c in kinds.items())))
    each = lambda name: of(s=F.col(f"_s.{name}") if name not in ("frameshift",) else F.lit(None), i=F.col(f"_i.{name}"), d=F.col(f"_d.{name}"))
    snp = lambda name: of(s=F.col(f"_s.{name}"))
    beside = F.col("_splice") & ~F.col("_coding")
    changed = beside | F.coalesce(of(i=F.col("_i.splicechange"), d=F.col("_over")), F.lit(False))
    made = {
        "cds_len": of(s=n, i=n, d=n),
        "cds_from": of(s=C.cds_strand_position(), i=C.cds_strand_position(), d=F.when(plus, left).otherwise(n - right + 1)),
        "cds_to": of(d=F.when(plus, right).otherwise(n - left + 1)),
        "codon_pos": F.coalesce(snp("codon_pos"), F.when(beside, motif_place)),
        "codon": F.coalesce(snp("codon"), F.when(beside, motif)),
        **{c: snp(c) for c in ("kind", "ref_aa", "new_aa", "codon_alt", "degeneracy")},
        "new_stop": of(s=F.col("_s.new_stop").cast("int"), i=F.col("_i.new_stop"), d=F.col("_d.new_stop")).cast("int"),
        **{c: each(c) for c in ("lost_stop", "lost_start", "frameshift")},
        "splicechange": changed,
    }
    where = C.location(F.col("gene").isNotNull(), F.col("_coding"), F.col("_splice"), F.when(is_a("D"), F.col("_regions")).otherwise(F.lit(coding)))
    own = [F.col(f"`{c}`") for c in variants.columns]
    begin = rows.withColumn("_pos", pos).withColumn("hit_end", F.least(end, "g_end")).withColumn("pos", F.greatest("pos", "g_start"))
    placed = begin.withColumn("gene_pos", C.gene_position()).withColumn("pos", F.col("_pos"))
    return placed.select(*own, "gene", "strand", "g_start", "g_end", where.alias("stype"), "gene_pos", *(made[c].alias(c) for c in EFFECTS))


def _joined(*columns: Column | str) -> Column:
    return F.concat_ws("\t", *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns))


def annotated_line(sample: Column, fields: tuple[str, ...] = ()) -> Column:
    """A row of :func:`annotate` as text: place, sample, alleles, the variant's own fields,
    where it is, its gene, its place in the coding sequence (SNPs in splice sites: in the
    site's two bases), and its effects, as far as it has them."""
    gene = F.when(F.col("gene").isNotNull(), _joined("gene", F.lit("1"), "g_start", "g_end", "strand", "gene_pos"))
    snp = _joined("cds_len", "cds_from", "codon_pos", "kind", "ref_aa", "new_aa", "codon", "degeneracy")
    deletion = _joined("cds_len", "cds_from", "cds_to", F.col("cds_to") - F.col("cds_from") + 1)
    motif = F.when(F.col("vartype") == "S", F.when(F.col("splicechange"), _joined("codon_pos", "codon")))
    coding = F.when(F.col("vartype") == "S", snp).when(F.col("vartype") == "I", _joined("cds_len", "cds_from")).otherwise(deletion)
    effects = C.effect_list()
    return _joined("chrom", "pos", sample, "ref", "alt", *fields, "stype", gene, F.when(F.col("cds_from").isNotNull(), coding).otherwise(F.when(motif != "", motif)), F.when(effects != "", effects))


#: Fixed values of the format, as are the words for effects below.
MUT_HEADER = "chr\tstart\tend\tsample\ttype\tBPchange/sequence/length\tgene\tgene_pos\tcds_pos\tAAchange\tdegeneracy"


def mut_line(sample: Column) -> Column:
    """A row of :func:`annotate` for a track of mutations.  Coding SNPs that change the amino
    acid are nonsynonymous, others synonymous."""
    kind = F.col("vartype")
    end = F.when(kind == "D", F.col("pos") + F.col("len") - 1).when(kind == "I", F.col("pos") + 1).otherwise(F.col("pos"))
    type = (
        F.when(F.col("new_stop") > 0, F.concat(F.lit("premature_stop ("), F.col("new_stop").cast("string"), F.lit(")")))
        .when(F.col("lost_stop"), "lost_stop")
        .when(F.col("lost_start"), "lost_start")
        .when(F.col("splicechange"), "splicechange")
        .when(F.col("ref_aa") != F.col("new_aa"), "nonsynonymous")
        .when(F.col("ref_aa").isNotNull(), "synonymous")
        .otherwise(F.col("stype"))
    )
    change = F.when(kind == "I", F.concat(F.lit("+"), "seq")).when(kind == "D", F.concat(F.lit("-"), "seq")).otherwise(F.concat("ref", F.lit(">"), "alt"))
    gene = F.when(F.col("gene").isNotNull(), _joined("gene", "gene_pos"))
    cds = F.concat_ws("-", F.col("cds_from").cast("string"), F.col("cds_to").cast("string"))
    codon = F.when(kind == "S", _joined(F.concat("codon", F.lit(">"), "codon_alt"), F.concat("ref_aa", F.lit(">"), "new_aa"), "degeneracy"))
    return _joined("chrom", "pos", end, sample, type, change, gene, F.when(F.col("cds_from").isNotNull(), _joined(cds, codon)))


def counts_by_list(rows: DataFrame, *keys: str) -> DataFrame:
    """How many variants each list, role or type has, all together first (null keys)."""
    return rows.rollup(*keys).agg(F.count("*").alias("n"))
