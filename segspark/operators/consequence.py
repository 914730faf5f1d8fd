"""What variants do to genes: codons, splice sites, frames, starts and stops.

Positions inside a coding sequence are closed forms over running sums of exon lengths,
so variants need no order and every effect is a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segspark.functions.sequence import STOPS, codon_at, degeneracy, mark_base, replace_base, revcomp, translate_codon


def variant_kind(rows: DataFrame) -> DataFrame:
    """Adds ``vartype`` (S, I, D), ``len`` and ``seq`` (bases beyond the first one) of ``ref, alt``
    (comma list)."""
    single = ~F.col("alt").contains(",")
    kind = F.when((F.length("ref") > 1) & single, "D").when((F.length("alt") > 1) & single, "I").otherwise("S")
    longer = F.when(F.col("vartype") == "D", F.col("ref")).otherwise(F.col("alt"))
    sized = rows.withColumn("vartype", kind).withColumn("len", F.when(F.col("vartype") == "S", F.lit(1)).otherwise(F.greatest(F.length("ref"), F.length("alt")) - 1))
    return sized.withColumn("seq", F.when(F.col("vartype") != "S", F.substr(longer, F.lit(2))))


def explode_alternatives(rows: DataFrame) -> DataFrame:
    """A row for each alternative of a comma list."""
    return rows.withColumn("alt", F.explode(F.split("alt", ",")))


def sample_label() -> Column:
    """``na`` for several alternatives, else which of major > minor the alternative is in."""
    part = lambda x: F.when(F.contains(F.col(x), F.col("alt")), F.col(x)).otherwise("")
    return F.when(F.col("alt").contains(","), "na").otherwise(F.concat(part("major"), F.lit(">"), part("minor")))


def keep_allele(which: str) -> Column:
    """Of ``major`` and ``minor`` only variants whose alternative is that allele."""
    return F.col("alt") != F.col("minor" if which == "major" else "major")


def without_flags(patterns: list[str]) -> Column:
    """No pattern is found in the flags."""
    out = F.lit(True)
    for p in patterns:
        out = out & ~F.rlike("filter", F.lit(p))
    return out


def dedupe_features(features: DataFrame) -> DataFrame:
    """Of features of one gene with one start the last in the file (column ``line``)."""
    order = Window.partitionBy("chrom", "gene", "f_start").orderBy(F.desc("line"))
    return features.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def exon_offsets(exons: DataFrame) -> DataFrame:
    """Exons (gene, e_start, e_end) with ``exon_off`` (coding bases before), ``cds_len``, and the
    ends of their neighbours."""
    order = Window.partitionBy("gene").orderBy("e_start")
    size = F.col("e_end") - F.col("e_start") + 1
    return exons.select(
        "*",
        F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("exon_off"),
        F.sum(size).over(Window.partitionBy("gene")).alias("cds_len"),
        F.lag("e_end").over(order).alias("prev_end"),
        F.lead("e_start").over(order).alias("next_start"),
    )


def coding_sequence(exons: DataFrame) -> DataFrame:
    """``gene, cds``: sequences of the exons (gene, e_start, seq) in order of their starts."""
    parts = F.array_sort(F.collect_list(F.struct("e_start", "seq")))
    return exons.groupBy("gene").agg(F.array_join(F.transform(parts, lambda x: x["seq"]), "").alias("cds"))


def cds_position() -> Column:
    return (F.col("exon_off") + F.col("pos") - F.col("e_start") + 1).cast("int")


def first_isoform(name: Column, pattern: str = "(\\d+)$") -> Column:
    """Whether the isoform number that ``pattern`` finds in a name is 1, or there is none."""
    number = F.regexp_extract(name, pattern, 1)
    return (number == "") | (number == "1")


def peak_distance(peak: int = 1) -> Column:
    return F.abs(F.col("pos") - peak)


def gene_position() -> Column:
    """Place in the gene from its own first base on; ``hit_end`` is the end of a deletion
    inside the gene."""
    last = F.when(F.col("vartype") == "S", F.col("g_end") - F.col("pos") + 1).when(F.col("vartype") == "I", F.col("g_end") - F.col("pos")).otherwise(F.col("g_end") - F.col("hit_end") + 1)
    return F.when(F.col("strand") == "+", F.col("pos") - F.col("g_start") + 1).otherwise(last)


def cds_strand_position() -> Column:
    """``cds_pos`` counted on the gene's own strand."""
    return F.when(F.col("strand") == "+", F.col("cds_pos")).when(F.col("vartype") == "S", F.col("cds_len") - F.col("cds_pos") + 1).otherwise(F.col("cds_len") - F.col("cds_pos"))


def snp_consequence(rows: DataFrame, raw: Column | None = None) -> DataFrame:
    """Rows with ``cds, cds_len, cds_pos, strand, alt`` get ``codon, codon_pos, codon_alt, ref_aa,
    new_aa, degeneracy, kind, new_stop, lost_stop, lost_start``; codons are shown with the other
    bases in small letters.  ``raw`` is the codon on the plus strand where it is known; then
    ``cds`` isn't needed."""
    plus = F.col("strand") == "+"
    raw = codon_at(F.col("cds"), F.col("cds_pos")) if raw is None else raw
    out = rows.withColumn("_codon", F.when(plus, raw).otherwise(revcomp(raw)))
    out = out.withColumn("codon_pos", F.when(plus, (F.col("cds_pos") - 1) % 3 + 1).otherwise((F.col("cds_len") - F.col("cds_pos")) % 3 + 1).cast("int"))
    base = F.when(plus, F.col("alt")).otherwise(revcomp(F.col("alt")))
    out = out.withColumn("_alt", replace_base(F.col("_codon"), F.col("codon_pos"), base))
    out = out.withColumn("ref_aa", F.when(F.length("_codon") < 3, "NNN").otherwise(translate_codon(F.col("_codon")))).withColumn("new_aa", translate_codon(F.col("_alt")))
    changed = F.col("ref_aa") != F.col("new_aa")
    start = F.when(plus, F.col("cds_pos") <= 3).otherwise(F.col("cds_pos") >= F.col("cds_len") - 2)
    return out.select(
        *rows.columns,
        mark_base(F.col("_codon"), F.col("codon_pos")).alias("codon"),
        "codon_pos",
        mark_base(F.col("_alt"), F.col("codon_pos")).alias("codon_alt"),
        "ref_aa",
        "new_aa",
        degeneracy(F.col("_alt"), F.col("codon_pos")).alias("degeneracy"),
        F.when(changed, "Nonsyn").otherwise("Syn").alias("kind"),
        (changed & (F.col("new_aa") == "*")).alias("new_stop"),
        (changed & (F.col("ref_aa") == "*")).alias("lost_stop"),
        (changed & start & (F.col("new_aa") != "M")).alias("lost_start"),
    )


def stop_scan(cds: Column, at: Column) -> Column:
    """How many codons on from the one that holds 1-based ``at`` the first stop is (1: it is
    that codon); 0 if there is none.  A mark behind each codon keeps matches in the frame."""
    tail = F.substr(cds, (F.floor((F.greatest(at, F.lit(1)) - 1) / 3) * 3 + 1).cast("int"))
    marked = F.regexp_replace(tail, "(?s)(...)", "$1,")
    found = [F.nullif(F.instr(marked, stop + ","), F.lit(0)) for stop in STOPS]
    return F.when(tail.isNotNull(), F.coalesce(F.floor((F.least(*found) - 1) / 4) + 1, F.lit(0)).cast("int"))


def insertion_effects(rows: DataFrame) -> DataFrame:
    """Rows with ``cds, cds_len, cds_pos, strand, seq, pos, e_end`` get ``alt_cds, frameshift,
    splicechange, lost_start, lost_stop, new_stop`` (0: none)."""
    plus, at, n = F.col("strand") == "+", F.col("cds_pos"), F.col("cds_len")
    alt = F.concat(F.substr("cds", F.lit(1), at), F.col("seq"), F.substr("cds", at + 1))
    head, tail = at < 3, (at != n) & (at > n - 3)
    stop = stop_scan(F.when(plus, F.col("alt_cds")).otherwise(revcomp(F.col("alt_cds"))), F.when(plus, at).otherwise(n - at))
    return (
        rows.withColumn("alt_cds", alt)
        .withColumn("frameshift", F.length("seq") % 3 != 0)
        .withColumn("splicechange", (F.col("pos") == F.col("e_end")) & (at != n))
        .withColumn("lost_start", F.when(plus, head).otherwise(tail))
        .withColumn("new_stop", stop)
        .withColumn("lost_stop", F.when(plus, tail).otherwise(head) | (F.col("new_stop") == 0))
    )


def deletion_spans(hits: DataFrame) -> DataFrame:
    """One row for each variant and gene (vid, gene, cds_left, cds_right, splicechange) of its
    hits on exons (with exon_offsets, hit_start, hit_end, start, end): the coding bases that go."""
    left = F.col("exon_off") + F.col("hit_start") - F.col("e_start") + 1
    right = F.col("exon_off") + F.col("hit_end") - F.col("e_start") + 1
    over = ((F.col("end") > F.col("e_end")) & F.col("next_start").isNotNull()) | ((F.col("start") < F.col("e_start")) & F.col("prev_end").isNotNull())
    return hits.groupBy("vid", "gene").agg(F.min(left).cast("int").alias("cds_left"), F.max(right).cast("int").alias("cds_right"), F.bool_or(over).alias("splicechange"))


def deletion_effects(rows: DataFrame) -> DataFrame:
    """Rows with ``cds, cds_len, cds_left, cds_right, strand`` get ``alt_cds, frameshift,
    lost_start, lost_stop, new_stop`` (0: none)."""
    plus, left, right, n = F.col("strand") == "+", F.col("cds_left"), F.col("cds_right"), F.col("cds_len")
    alt = F.concat(F.substr("cds", F.lit(1), left - 1), F.substr("cds", right + 1))
    head, tail = left < 4, right >= n - 3
    stop = stop_scan(F.when(plus, F.col("alt_cds")).otherwise(revcomp(F.col("alt_cds"))), F.when(plus, left).otherwise(n - right + 1))
    return (
        rows.withColumn("alt_cds", alt)
        .withColumn("frameshift", (right - left + 1) % 3 != 0)
        .withColumn("lost_start", F.when(plus, head).otherwise(tail))
        .withColumn("new_stop", stop)
        .withColumn("lost_stop", F.when(plus, tail).otherwise(head) | (F.col("new_stop") == 0))
    )


def region_string(hits: DataFrame) -> DataFrame:
    """``vid, gene, regions``: what a deletion runs through, in order, with lengths, like
    ``CDS,3-intronic/noncoding,5`` (hits with ``hit_start, hit_end, type``; the gaps between them
    are introns)."""
    order = Window.partitionBy("vid", "gene").orderBy("hit_start")
    gap = F.col("hit_start") - F.lag("hit_end").over(order) - 1
    part = F.concat(F.col("type"), F.lit(","), F.col("hit_end") - F.col("hit_start") + 1)
    parts = hits.withColumn("_part", F.when(gap > 0, F.concat(F.lit("intronic/noncoding,"), gap, F.lit("-"), part)).otherwise(part))
    listed = F.array_sort(F.collect_list(F.struct("hit_start", "_part")))
    return parts.groupBy("vid", "gene").agg(F.array_join(F.transform(listed, lambda x: x["_part"]), "-").alias("regions"))


def splice_site() -> Column:
    """Whether a SNP or insertion in the intron between ``prev_end`` and ``next_start`` is in its
    first two or last two bases (one at the front for insertions)."""
    reach = 1 + (F.col("vartype") == "S").cast("int")
    inside = (F.col("pos") > F.col("prev_end")) & (F.col("pos") < F.col("next_start"))
    return inside & ((F.col("pos") <= F.col("prev_end") + reach) | (F.col("pos") >= F.col("next_start") - 2))


def splice_motif(raw: Column, front: Column) -> tuple[Column, Column]:
    """The two bases of a splice site on the gene's own strand, and which of them a SNP hits, from
    the bases on the plus strand and the SNP's place (1 or 2) in them."""
    plus = F.col("strand") == "+"
    place = F.when(plus, front).otherwise(3 - front).cast("int")
    return mark_base(F.when(plus, raw).otherwise(revcomp(raw)), place), place


def location(has_gene: Column, has_exon: Column, in_splice: Column, type: Column) -> Column:
    return F.when(~has_gene, "intergenic").when(has_exon, type).when(in_splice, "splicesite").otherwise("intronic/noncoding")


def effect_label() -> Column:
    """One word for a track of mutations."""
    return F.when(F.col("new_stop"), "nonsense").when(F.col("lost_start") | F.col("lost_stop"), "start/stop lost").when(F.col("ref_aa") != F.col("new_aa"), "missense").otherwise("synonymous")


def effect_list() -> Column:
    """All effects as a comma list; a new stop with the number of its codon after the change."""
    stop = F.when(F.col("new_stop").cast("int") > 0, F.concat(F.lit("new_stop ("), F.col("new_stop").cast("int").cast("string"), F.lit(")")))
    names = ("lost_stop", "lost_start", "splicechange", "frameshift")
    return F.array_join(F.array_compact(F.array(stop, *(F.when(F.col(n).cast("int") > 0, n) for n in names))), ",")


_EDIT = "struct<cds_left:int,cds_right:int,vartype:string,seq:string,upto:int,at:int>"


def gene_alignment(genes: DataFrame, edits: DataFrame) -> DataFrame:
    """``gene, ref, alt, edited``: the gapped coding sequence (genes: gene, strand, cds) with all
    edits (gene, vartype, cds_left, cds_right, seq) put in, on the gene's own strand, and how many.
    An edit that begins before the one before it ended is left out.

    One sweep over a gene's edits in order notes which count and where each ends; the pieces
    between and in them are then cut out by these places and joined once."""
    insert = F.col("vartype") == "I"
    upto = F.when(insert, F.col("cds_left")).otherwise(F.col("cds_left") - 1)
    e = F.struct("cds_left", "cds_right", "vartype", "seq", upto.cast("int").alias("upto"), F.greatest(upto, "cds_right").cast("int").alias("at"))
    listed = edits.groupBy("gene").agg(F.array_sort(F.collect_list(e)).alias("edits"))
    none = F.array().cast(f"array<{_EDIT}>")
    end_of = lambda a, i: F.when(i > 0, F.get(a, i - 1)["at"]).otherwise(0)
    sweep = F.aggregate(F.coalesce(F.col("edits").cast(f"array<{_EDIT}>"), none), none, lambda a, x: F.when(x["upto"] < end_of(a, F.size(a)), a).otherwise(F.concat(a, F.array(x))))
    rows = genes.join(listed, "gene", "left").withColumn("_kept", sweep)
    cds, kept = F.col("cds"), F.col("_kept")

    def line(change) -> Column:
        between = lambda x, i: F.substr(cds, end_of(kept, i) + 1, x["upto"] - end_of(kept, i))
        parts = F.transform(kept, lambda x, i: F.concat(between(x, i), change(x)))
        return F.concat(F.array_join(parts, ""), F.substr(cds, end_of(kept, F.size(kept)) + 1))

    gone = lambda x: F.when(x["vartype"] == "I", F.repeat(F.lit("-"), F.length(x["seq"]))).otherwise(F.substr(cds, x["cds_left"], x["cds_right"] - x["cds_left"] + 1))
    new = lambda x: F.when(x["vartype"] == "D", F.repeat(F.lit("-"), x["cds_right"] - x["cds_left"] + 1)).otherwise(x["seq"])
    turn = lambda x: F.when(F.col("strand") == "+", x).otherwise(revcomp(x))
    return rows.select("gene", turn(line(gone)).alias("ref"), turn(line(new)).alias("alt"), F.size(kept).alias("edited"))


def alignment_lines() -> Column:
    """An aligned gene (gene, ref, alt) as lines of text: its name, the reference, the variant."""
    return F.concat_ws("\n", F.concat(F.lit(">"), F.col("gene").cast("string")), "ref", "alt")
