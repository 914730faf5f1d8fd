"""Queries of the annotation from end to end, of readers, writers and smaller steps, with
their SQL.  Importing it adds them to those of plans.queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from segspark.functions import sequence as S
from segspark.functions import stats as T
from segspark.operators import annotate as A
from segspark.operators import consequence, mapping, normalise, off_targets, primer_pairs, primers, quality
from segspark.plans import domain as D
from segspark.plans import queries as Q
from segspark.plans.queries import query
from segspark.sources import sinks
from segspark.sources import text as R

# ---- annotation


def _annotated(spark, d):
    kinds = D.written(consequence.variant_kind(D.variants(spark, d)).withColumn("len", F.col("len").cast("int")))
    exons = consequence.exon_offsets(D.exons(spark, d))
    cds = exons.groupBy("gene").agg(F.max("cds_len").cast("int").alias("n")).select("gene", F.substr(F.expr(D.DNA), F.lit(1), F.col("n")).alias("cds"))
    genes = D.genes(spark, d)
    return A.annotate(kinds, genes, exons, cds, sequences=genes.select("gene", F.expr(D.DNA).alias("seq")))


_INDEX = " + ".join(f"{w} * (instr('TCAG', substr(codon_alt, {i}, 1)) - 1)" for i, w in ((1, 16), (2, 4), (3, 1)))
_SNP_PART = Q.CODING_SNPS + (
    "SELECT vid, gene, n AS cds_len, CASE WHEN strand = '+' THEN cp ELSE n - cp + 1 END AS cds_from, CAST(NULL AS INT) AS cds_to, CAST(cpos AS INT) AS codon_pos, CASE WHEN ref_aa = new_aa THEN 'Syn' ELSE 'Nonsyn' END AS kind, ref_aa, new_aa, "
    "lower(substr(codon, 1, cpos - 1)) || substr(codon, cpos, 1) || lower(substr(codon, cpos + 1)) AS codon, lower(substr(codon_alt, 1, cpos - 1)) || substr(codon_alt, cpos, 1) || lower(substr(codon_alt, cpos + 1)) AS codon_alt, "
    f"CASE WHEN length(codon_alt) = 3 THEN substr('{S.DEGENERACY}', CAST(3 * ({_INDEX}) + cpos AS INT), 1) ELSE '-' END AS degeneracy, "
    "CAST(ref_aa <> new_aa AND new_aa = '*' AS INT) AS new_stop, ref_aa <> new_aa AND ref_aa = '*' AS lost_stop, ref_aa <> new_aa AND new_aa <> 'M' AND CASE WHEN strand = '+' THEN cp <= 3 ELSE cp >= n - 2 END AS lost_start, FALSE AS splicechange, FALSE AS frameshift FROM w"
)
_TURNED = "CASE WHEN strand = '+' THEN alt_cds ELSE translate(reverse(alt_cds), 'ACGT', 'TGCA') END AS c"
_NONE = "CAST(NULL AS INT) AS codon_pos, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS ref_aa, CAST(NULL AS VARCHAR) AS new_aa, CAST(NULL AS VARCHAR) AS codon, CAST(NULL AS VARCHAR) AS codon_alt, CAST(NULL AS VARCHAR) AS degeneracy"
_INS_PART = Q.CODING_INS + (
    f", s AS (SELECT *, {_TURNED}, CASE WHEN strand = '+' THEN cp ELSE n - cp END AS spot FROM a), z AS (SELECT *, CAST({Q._stop_sql('c', 'spot')} AS INT) AS new_stop FROM s) "
    f"SELECT vid, gene, n AS cds_len, CASE WHEN strand = '+' THEN cp ELSE n - cp END AS cds_from, CAST(NULL AS INT) AS cds_to, {_NONE}, new_stop, CASE WHEN strand = '+' THEN cp <> n AND cp > n - 3 ELSE cp < 3 END OR new_stop = 0 AS lost_stop, "
    "CASE WHEN strand = '+' THEN cp < 3 ELSE cp <> n AND cp > n - 3 END AS lost_start, pos = e_end AND cp <> n AS splicechange, length(seq) % 3 <> 0 AS frameshift FROM z"
)
_DEL_PART = Q.DEL_SPANS + (
    f", a AS (SELECT *, substr(dna, 1, l - 1) || substr(substr(dna, 1, n), r + 1) AS alt_cds FROM g), s AS (SELECT *, {_TURNED}, CASE WHEN strand = '+' THEN l ELSE n - r + 1 END AS spot FROM a), z AS (SELECT *, CAST({Q._stop_sql('c', 'spot')} AS INT) AS new_stop FROM s) "
    f"SELECT vid, gene, n AS cds_len, CASE WHEN strand = '+' THEN l ELSE n - r + 1 END AS cds_from, CASE WHEN strand = '+' THEN r ELSE n - l + 1 END AS cds_to, {_NONE}, new_stop, CASE WHEN strand = '+' THEN r >= n - 3 ELSE l < 4 END OR new_stop = 0 AS lost_stop, "
    "CASE WHEN strand = '+' THEN l < 4 ELSE r >= n - 3 END AS lost_start, splicechange, (r - l + 1) % 3 <> 0 AS frameshift FROM z"
)
_SPLICE = f"WITH {D.VARIANT_CTE}, {Q.KIND}, {D.EXON_CTE}, {Q.OFFSETS} SELECT vid, gene, TRUE AS splice, any_value(CASE WHEN vartype = 'S' THEN pos - CASE WHEN pos <= e_end + 2 THEN e_end + 1 ELSE next_start - 2 END + 1 END) AS sp, any_value(substr({D.DNA}, CAST(CASE WHEN pos <= e_end + 2 THEN e_end + 1 ELSE next_start - 2 END - g_start + 1 AS INT), 2)) AS two, any_value(strand) AS sst FROM vk JOIN ex ON vk.chrom = ex.chrom AND vartype <> 'D' AND next_start IS NOT NULL AND pos > e_end AND pos < next_start AND (pos <= e_end + 1 + CAST(vartype = 'S' AS INT) OR pos >= next_start - 2) GROUP BY vid, gene"
_REGIONS = (
    f"WITH {D.VARIANT_CTE}, {Q.KIND}, {D.EXON_CTE}, h AS (SELECT vid, gene, greatest(pos, e_start) AS s, least(pos + len - 1, e_end) AS e FROM vk JOIN exons ON vk.chrom = exons.chrom AND vartype = 'D' AND pos <= e_end AND pos + len - 1 >= e_start), "
    "p AS (SELECT *, s - lag(e) OVER (PARTITION BY vid, gene ORDER BY s) - 1 AS gap FROM h) SELECT vid, gene, string_agg(CASE WHEN gap > 0 THEN concat('intronic/noncoding,', gap, '-') ELSE '' END || concat('CDS,', e - s + 1), '-' ORDER BY s) AS regions FROM p GROUP BY vid, gene"
)
ANNOTATED = (
    f"WITH {D.VARIANT_CTE}, {Q.KIND}, {D.GENE_CTE}, gh AS (SELECT vk.*, gene, strand, g_start, g_end, CASE WHEN vartype = 'D' THEN pos + len - 1 ELSE pos END AS e FROM vk LEFT JOIN genes ON vk.chrom = genes.chrom AND pos <= g_end AND CASE WHEN vartype = 'D' THEN pos + len - 1 ELSE pos END >= g_start AND (vartype <> 'I' OR pos < g_end)), "
    f"ef AS (({_SNP_PART}) UNION ALL ({_INS_PART}) UNION ALL ({_DEL_PART})), sp AS ({_SPLICE}), rg AS ({_REGIONS}), "
    "an AS (SELECT gh.*, CASE WHEN gh.gene IS NULL THEN 'intergenic' WHEN ef.cds_from IS NOT NULL THEN coalesce(regions, 'CDS') WHEN splice THEN 'splicesite' ELSE 'intronic/noncoding' END AS stype, "
    "CASE WHEN gh.strand = '+' THEN greatest(pos, g_start) - g_start + 1 WHEN vartype = 'S' THEN g_end - pos + 1 WHEN vartype = 'I' THEN g_end - pos ELSE g_end - least(e, g_end) + 1 END AS gene_pos, "
    "cds_len, cds_from, cds_to, codon_pos, kind, ref_aa, new_aa, codon, codon_alt, degeneracy, new_stop, lost_stop, lost_start, CASE WHEN vartype = 'S' AND cds_from IS NULL THEN CASE WHEN sst = '+' THEN sp ELSE 3 - sp END END AS mp, CASE WHEN sst = '+' THEN two ELSE translate(reverse(two), 'ACGT', 'TGCA') END AS motif, coalesce(splicechange, FALSE) OR (splice IS NOT NULL AND cds_from IS NULL) AS splicechange, frameshift "
    "FROM gh LEFT JOIN ef ON gh.vid = ef.vid AND gh.gene = ef.gene LEFT JOIN sp ON gh.vid = sp.vid AND gh.gene = sp.gene LEFT JOIN rg ON gh.vid = rg.vid AND gh.gene = rg.gene) "
)
_FEATURES = "nullif(concat_ws(',', CASE WHEN new_stop > 0 THEN concat('new_stop (', new_stop, ')') END, CASE WHEN lost_stop THEN 'lost_stop' END, CASE WHEN lost_start THEN 'lost_start' END, CASE WHEN splicechange THEN 'splicechange' END, CASE WHEN frameshift THEN 'frameshift' END), '')"
TAB = "chr(9)"


@query(
    "annotated_table",
    ANNOTATED + f"SELECT concat_ws({TAB}, chrom, pos, 'pool', ref, alt, filter, stype, CASE WHEN gene IS NOT NULL THEN concat_ws({TAB}, gene, 1, g_start, g_end, strand, gene_pos) END, "
    f"CASE WHEN cds_from IS NULL THEN CASE WHEN mp IS NOT NULL THEN concat_ws({TAB}, mp, CASE WHEN mp = 1 THEN substr(motif, 1, 1) || lower(substr(motif, 2, 1)) ELSE lower(substr(motif, 1, 1)) || substr(motif, 2, 1) END) END WHEN vartype = 'S' THEN concat_ws({TAB}, cds_len, cds_from, codon_pos, kind, ref_aa, new_aa, codon, degeneracy) WHEN vartype = 'I' THEN concat_ws({TAB}, cds_len, cds_from) ELSE concat_ws({TAB}, cds_len, cds_from, cds_to, cds_to - cds_from + 1) END, {_FEATURES}) AS line FROM an",
)
def annotated_table(spark, d):
    return _annotated(spark, d).select(A.annotated_line(F.lit("pool"), ("filter",)).alias("line"))


@query(
    "mut_lines",
    ANNOTATED + f"SELECT concat_ws({TAB}, chrom, pos, CASE vartype WHEN 'D' THEN pos + len - 1 WHEN 'I' THEN pos + 1 ELSE pos END, 'pool', "
    "CASE WHEN new_stop > 0 THEN concat('premature_stop (', new_stop, ')') WHEN lost_stop THEN 'lost_stop' WHEN lost_start THEN 'lost_start' WHEN splicechange THEN 'splicechange' WHEN ref_aa <> new_aa THEN 'nonsynonymous' WHEN ref_aa IS NOT NULL THEN 'synonymous' ELSE stype END, "
    f"CASE vartype WHEN 'I' THEN '+' || seq WHEN 'D' THEN '-' || seq ELSE ref || '>' || alt END, CASE WHEN gene IS NOT NULL THEN concat_ws({TAB}, gene, gene_pos) END, "
    f"CASE WHEN cds_from IS NOT NULL THEN concat_ws({TAB}, concat_ws('-', cds_from, cds_to), CASE WHEN vartype = 'S' THEN concat_ws({TAB}, codon || '>' || codon_alt, ref_aa || '>' || new_aa, degeneracy) END) END) AS line FROM an",
)
def mut_lines(spark, d):
    return _annotated(spark, d).select(A.mut_line(F.lit("pool")).alias("line"))


@query("location_counts", ANNOTATED + "SELECT stype, vartype, count(*) AS n FROM an WHERE vartype <> 'D' GROUP BY stype, vartype")
def location_counts(spark, d):
    return _annotated(spark, d).filter("vartype <> 'D'").groupBy("stype", "vartype").agg(F.count("*").alias("n"))


@query("effect_list", ANNOTATED + f"SELECT vartype, coalesce({_FEATURES}, '') AS effects, count(*) AS n FROM an WHERE cds_from IS NOT NULL GROUP BY 1, 2")
def effect_list(spark, d):
    rows = _annotated(spark, d).filter("cds_from IS NOT NULL")
    return rows.groupBy("vartype", consequence.effect_list().alias("effects")).agg(F.count("*").alias("n"))


@query("role_counts", f"WITH {D.VARIANT_CTE}, {Q.ROLES} SELECT role, CASE WHEN length(ref) > 1 OR length(alt) > 1 THEN 'indel' WHEN ref <> alt THEN 'SNP' ELSE '.' END AS type, count(*) AS n FROM r WHERE role IS NOT NULL GROUP BY ROLLUP (role, type)")
def role_counts(spark, d):
    return A.counts_by_list(Q._roles(spark, d), "role", "type")


@query("retained_counts", f"WITH {D.SNP_CTE}, {Q.MEDIANS} SELECT count(*) FILTER (WHERE {Q.BAND} AND lineno % 3 = 0) AS retained, count(*) AS total FROM snps, m")
def retained_counts(spark, d):
    rows = D.snps(spark, d)
    kept = quality.coverage_band(rows, 0.5).filter(quality.legal_flags("pass"))
    return quality.retained(rows, kept)


@query("keep_allele", f"WITH {D.VARIANT_CTE} SELECT vid, filter = 'PASS' AS major FROM variants WHERE CASE WHEN filter = 'PASS' THEN alt <> ref ELSE alt <> substr(ref, 1, 1) END")
def keep_allele(spark, d):
    rows = D.variants(spark, d).withColumn("major", F.substr("ref", F.lit(1), F.lit(1))).withColumn("minor", F.col("ref"))
    a = rows.filter("filter = 'PASS'").filter(consequence.keep_allele("major")).withColumn("major", F.lit(True))
    b = rows.filter("filter <> 'PASS'").filter(consequence.keep_allele("minor")).withColumn("major", F.lit(False))
    return a.unionByName(b).select("vid", "major")


@query("first_isoforms", "SELECT p_partkey, CAST(p_partkey % 4 AS INT) AS isoform FROM part WHERE p_partkey % 4 IN (0, 1)")
def first_isoforms(spark, d):
    name = F.concat(F.lit("gene"), F.when(F.col("p_partkey") % 4 == 0, ".x").otherwise(F.concat(F.lit(".t"), (F.col("p_partkey") % 4).cast("string"))))
    rows = D.table(spark, d, "part").select("p_partkey", name.alias("name"))
    return rows.filter(consequence.first_isoform(F.col("name"), "t(\\d+)$")).select("p_partkey", (F.col("p_partkey") % 4).cast("int").alias("isoform"))


@query("dedupe_features", f"WITH {D.GENE_CTE}, f AS (SELECT chrom, gene // 3 AS gene, g_start // 30000 AS f_start, gene AS line FROM genes) SELECT chrom, gene, f_start, max(line) AS line FROM f GROUP BY chrom, gene, f_start")
def dedupe_features(spark, d):
    rows = D.genes(spark, d).selectExpr("chrom", "gene DIV 3 AS gene", "g_start DIV 30000 AS f_start", "gene AS line")
    return consequence.dedupe_features(rows).select("chrom", "gene", "f_start", "line")


@query("balanced_sample", f"WITH {D.SNP_CTE} SELECT pos >= 7000000 AS side, least(count(*), 500) AS n FROM snps GROUP BY 1")
def balanced_sample(spark, d):
    rows = mapping.balanced_sample(D.snps(spark, d), 7_000_000, 500)
    return rows.groupBy((F.col("pos") >= 7_000_000).alias("side")).agg(F.count("*").alias("n"))


@query("beta_params_plain", f"WITH {D.SNP_CTE}, {Q.PODD} SELECT chrom, pos, vid, round(2.0 * 178 * (1 - podd - 1e-3), 6) AS ra, round(2.0 * 178 * (podd + 1e-3), 6) AS rb, round(2.0 * 178 * (1 + podd + 1e-3) / 3, 6) AS sa, round(2.0 * 280 * (2 - podd - 1e-3) / 3, 6) AS sb FROM p")
def beta_params_plain(spark, d):
    rows, podd = Q._podd(spark, d)
    (ra, rb), (sa, sb) = (T.beta_params_plain(podd, pool, 178.0, 280.0, 1e-3) for pool in ("res", "sus"))
    return rows.select(*Q.KEY, *(F.round(c, 6).alias(n) for c, n in ((ra, "ra"), (rb, "rb"), (sa, "sa"), (sb, "sb"))))


# ---- files: written, read back

def _pooled_text(spark, d):
    rows = normalise.normalise(Q._parsed(spark, d), Q.DESIGN)
    header = spark.createDataFrame([(x,) for x in sinks.pooled_header(["res", "sus"], ["##source=calls"], "normalise")], "value string")
    return D.as_files(rows.select(sinks.pooled_line(["res", "sus"]).alias("value")).unionByName(header), path_only=True)


@query(
    "read_pooled",
    f"WITH {Q.CALL_CTE}, {Q.SWITCH} SELECT chrom, pos, CASE WHEN sw THEN alt || ref ELSE ref || alt END AS alleles, CAST(qual AS DOUBLE) AS qual, CASE WHEN sw THEN b1 ELSE a1 END AS res_major, CASE WHEN sw THEN a1 ELSE b1 END AS res_minor, CASE WHEN sw THEN b2 ELSE a2 END AS sus_major, CASE WHEN sw THEN a2 ELSE b2 END AS sus_minor "
    "FROM sw WHERE seen AND NOT multi AND length(ref) = 1 AND length(alt) = 1 AND ref <> alt",
)
def read_pooled(spark, d):
    """Normalised calls, written as a table with its header and read back from it."""
    rows = R.read_pooled(spark, _pooled_text(spark, d), "res", "sus")
    return rows.select("chrom", "pos", F.array_join("alleles_res", "").alias("alleles"), "qual", "res_major", "res_minor", "sus_major", "sus_minor")


@query(
    "read_normalised",
    f"WITH {Q.CALL_CTE}, {Q.SWITCH} SELECT chrom, pos, ref, alt, CASE WHEN multi THEN NULL WHEN sw THEN alt ELSE ref END AS major, CASE WHEN multi THEN NULL WHEN sw THEN ref ELSE alt END AS minor, CAST(qual AS DOUBLE) AS qual, "
    "CASE WHEN multi THEN 'multi-allelic' WHEN length(ref) > 1 OR length(alt) > 1 THEN 'indel' WHEN ref <> alt THEN 'SNP' ELSE '.' END AS type, CASE WHEN seen THEN CASE WHEN sw THEN b1 + b2 ELSE a1 + a2 END END AS segr_major, CASE WHEN seen THEN CASE WHEN sw THEN a1 + a2 ELSE b1 + b2 END END AS segr_minor FROM sw",
)
def read_normalised(spark, d):
    """Normalised calls of all types, written as a table and read back for primer design."""
    return R.read_normalised(spark, _pooled_text(spark, d)).drop("id", "flags")


@query("pooled_header", f"SELECT unnest(['{sinks.FORMAT}', '##source=calls', '##commandline=normalise', concat_ws(chr(9), '#CHROM', 'POS', 'ID', 'REF', 'ALT', 'MAJOR', 'MINOR', 'QUAL', 'FILTER', 'TYPE', 'SEGR', 'HAPSC', 'FORMAT', 'res', 'sus')]) AS line")
def pooled_header(spark, d):
    return spark.read.text(_pooled_text(spark, d)).filter(F.col("value").startswith("#")).select(F.col("value").alias("line"))


@query(
    "read_two_sample_calls",
    f"WITH {Q.CALL_CTE} SELECT chrom, pos, ref || alt AS alleles, CAST(qual AS DOUBLE) AS qual, a1 AS res_major, b1 AS res_minor, g1 AS geno_res, CASE WHEN NOT gone THEN a2 END AS sus_major, CASE WHEN NOT gone THEN b2 END AS sus_minor, CASE WHEN gone THEN './.' ELSE g2 END AS geno_sus FROM calls",
)
def read_two_sample_calls(spark, d):
    rows = D.project(D.table(spark, d, "lineitem"), Q.CALLS)
    line = F.concat_ws("\t", F.concat(F.lit("s1chr"), "chrom"), "pos", F.lit("."), "ref", "alt", "qual", "filter", F.lit("GT:AD:DP:GQ:PL"), F.expr(Q.SAMPLE1), F.expr(f"CASE WHEN gone THEN './.' ELSE {Q.SAMPLE2} END"))
    got = R.read_two_sample_calls(spark, D.as_files(rows.select(line.alias("value")), path_only=True))
    return got.select("chrom", "pos", F.array_join("alleles_res", "").alias("alleles"), "qual", "res_major", "res_minor", "geno_res", "sus_major", "sus_minor", "geno_sus")


_TABLE = {
    "sus_a1": "ref", "sus_a2": "alt", "sus_n1": "sus_major", "sus_n2": "sus_minor",
    "res_a1": "CASE WHEN lineno % 3 = 0 THEN alt ELSE ref END", "res_a2": "CASE WHEN lineno % 3 = 0 THEN ref ELSE alt END", "res_n1": "res_major", "res_n2": "res_minor",
    "um_a1": "CASE WHEN lineno % 2 = 0 THEN ref ELSE alt END", "um_a2": "CASE WHEN lineno % 5 = 0 THEN alt ELSE 'N' END", "um_n1": "sus_major", "um_n2": "0",
    "tn1_a1": "CASE WHEN lineno % 2 = 0 THEN alt ELSE ref END", "tn1_a2": "'N'", "tn1_n1": "res_major", "tn1_n2": "0",
}
_OLD = ", ".join(f"{x} AS {c}" for c, x in _TABLE.items())


def _old_table(spark, d):
    rows = D.snps(spark, d).select("chrom", "pos", *(F.expr(x).alias(c) for c, x in _TABLE.items()))
    pool = lambda p: [f"{p}_a1", f"{p}_a2", f"{p}_n1", f"{p}_n2"]
    line = F.concat_ws(" ", "chrom", "pos", *pool("sus"), *pool("res"), *(F.lit("x") for _ in range(4)), *pool("um"), *pool("tn1"))
    header = spark.createDataFrame([("chrom pos alleles",)], "value string")
    return R.read_allele_table(spark, D.as_files(rows.select(line.alias("value")).unionByName(header), path_only=True))


@query("read_allele_table", f"WITH {D.SNP_CTE} SELECT chrom, pos, {_OLD} FROM snps")
def read_allele_table(spark, d):
    return _old_table(spark, d).select("chrom", "pos", *_TABLE)


@query(
    "allele_flip",
    f"WITH {D.SNP_CTE}, o AS (SELECT chrom, pos, {_OLD} FROM snps), k AS (SELECT *, res_a2 = tn1_a1 OR res_a1 = um_a1 AS fr, sus_a2 = tn1_a1 OR sus_a1 = um_a1 AS fs FROM o WHERE um_a2 = 'N' AND tn1_a2 = 'N' AND um_n1 > 8 AND tn1_n1 > 8 AND sus_n1 + sus_n2 > 8 AND sus_n1 + sus_n2 < 300 AND res_n1 + res_n2 > 8 AND res_n1 + res_n2 < 300) "
    "SELECT chrom, pos, CASE WHEN fr THEN res_a2 || res_a1 ELSE res_a1 || res_a2 END AS res_alleles, CASE WHEN fs THEN sus_a2 || sus_a1 ELSE sus_a1 || sus_a2 END AS sus_alleles, CASE WHEN fr THEN res_n2 ELSE res_n1 END AS res_n1, CASE WHEN fr THEN res_n1 ELSE res_n2 END AS res_n2, CASE WHEN fs THEN sus_n2 ELSE sus_n1 END AS sus_n1, CASE WHEN fs THEN sus_n1 ELSE sus_n2 END AS sus_n2 FROM k",
)
def allele_flip(spark, d):
    """The older mapper's path: its table read, filtered, and aligned with the parents."""
    rows = quality.flip_by_parents(_old_table(spark, d).filter(quality.depth_and_parents()))
    return rows.select("chrom", "pos", F.concat("res_a1", "res_a2").alias("res_alleles"), F.concat("sus_a1", "sus_a2").alias("sus_alleles"), "res_n1", "res_n2", "sus_n1", "sus_n2")


@query(
    "read_gff",
    f"WITH {D.GENE_CTE} SELECT chrom, 'gene' AS type, g_start AS start, g_end AS \"end\", strand, 'g' || CAST(gene AS VARCHAR) AS name FROM genes WHERE chrom = 'RF' AND g_end >= 1000000 AND g_start <= 9000000",
)
def read_gff(spark, d):
    rows = D.genes(spark, d)
    line = F.concat_ws("\t", F.concat(F.lit("chr"), "chrom", F.lit("_v1")), F.lit("src"), F.lit("gene"), "g_start", "g_end", F.lit("."), "strand", F.lit("."), F.concat(F.lit("ID=x-g"), "gene", F.lit(".1;Note=a")))
    config = R.gff_config(["GENE_FEATURE\tgene#locus", "GENE_TAG\tID", "GENE_SPLITSTRING\t-2", "CROP_CHR_GFF_START\tchr", "CROP_CHR_GFF_END\t_v1"])
    path = D.as_files(rows.select(line.alias("value")), path_only=True)
    got = R.read_gff(spark, path, "RF", 1_000_000, 9_000_000, config["CROP_CHR_GFF_START"][0], config["CROP_CHR_GFF_END"][0]).filter(F.col("type").isin(config["GENE_FEATURE"]))
    return got.select("chrom", "type", "start", "end", "strand", R.feature_name(F.col("attributes"), config["GENE_TAG"][0], config["GENE_SPLITSTRING"][0]).alias("name"))


@query("read_fasta", f"WITH {D.GENE_CTE} SELECT 'g' || CAST(gene AS VARCHAR) AS chrom, CAST(i AS BIGINT) AS chunk, md5(substr(s, CAST(1 + 1000 * i AS INT), 1000)) AS seq FROM (SELECT gene, {D.DNA} AS s, unnest(range(0, 7)) AS i FROM genes)")
def read_fasta(spark, d):
    """Sequences as FASTA files with lines of 60 bases, read in chunks of 1000."""
    lines = F.regexp_replace(F.expr(D.DNA), "(.{60})", "$1\n")
    text = D.genes(spark, d).select(F.concat(F.lit(">g"), "gene", F.lit(" of a hash\n"), lines).alias("value"))
    return R.read_fasta(spark, D.as_files(text, path_only=True), chunk=1000).select("chrom", "chunk", F.md5("seq").alias("seq"))


_PRIMER = {"chrom": "chrom", "pos": "CAST(pos AS STRING)", "id": "CASE WHEN filter = 'PASS' THEN vid ELSE '.' END", "ref": "ref", "alt": "alt", "major": "ref", "minor": "alt", "qual": "'.'", "filter": "filter", "type": "'SNP'", "segr": "NULL", "direction": "'fwd'", "primer_left": "'ACGT'", "primer_right": "'TTTT'", "product_len": "'300'", "n_count": "'0'", "product_seq": "ref || alt"}


@query("primer_table", f"WITH {D.VARIANT_CTE} SELECT chrom, pos, vid AS id, ref, alt, '.' AS segr, 'fwd' AS direction, ref || alt AS product_seq FROM variants WHERE filter = 'PASS'")
def primer_table(spark, d):
    """Primer rows written as lines and read back; rows without an id don't come back."""
    rows = D.variants(spark, d).selectExpr(*(f"{x} AS {c}" for c, x in _PRIMER.items()))
    got = R.read_primers(spark, D.as_files(rows.select(sinks.primer_line().alias("value")), path_only=True))
    return got.select("chrom", "pos", "id", "ref", "alt", "segr", "direction", "product_seq")


@query("score_files", f"WITH {Q._scored('500000')} SELECT chrom, pos, round(score, 3) AS score FROM score")
def score_files(spark, d):
    """Scores written as comma-separated files, a folder for each chromosome, and read back."""
    path = D.scratch(spark, "scores")
    sinks.write_scores(Q._score(spark, d), path)
    got = spark.read.schema("name string, pos long, score double").csv(path + "/*")
    return got.select(F.col("name").alias("chrom"), "pos", F.round("score", 3).alias("score"))


@query("haplotype_scores", f"WITH {Q.CALL_CTE} SELECT chrom, pos, CASE WHEN l_odd THEN round(a1 / 100.0, 2)::DOUBLE END AS hapsc FROM (SELECT *, pos % 2 = 1 AS l_odd FROM calls)")
def haplotype_scores(spark, d):
    rows = D.project(D.table(spark, d, "lineitem"), Q.CALLS)
    info = F.when(F.col("pos") % 2 == 1, F.concat(F.lit("SB=1;HaplotypeScore="), F.round(F.col("a1") / 100, 2).cast("string"))).otherwise("SB=1")
    line = F.concat_ws("\t", "chrom", "pos", F.lit("."), "ref", "alt", "qual", "filter", info, F.lit("GT:AD:DP:GQ:PL"), F.expr(Q.SAMPLE1), F.expr(Q.SAMPLE2))
    return normalise.normalise(R.parse_vcf(D.as_files(rows.select(line.alias("value"))), ["res", "sus"]), Q.DESIGN).select("chrom", "pos", "hapsc")


# ---- primer design from end to end


#: 832 bases for each gene, from the digits of hashes.
_BASES = "translate(array_join(transform(sequence(1, 26), i -> md5(concat(gene, ':', i))), ''), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _designs(genes, chunks, direction: str):
    """Accepted designs of one direction: template, picked primers, one match of each in all
    sequences, product.  The SNP is base 401 of a gene's sequence (``seq``)."""
    layout = primers.Layout()
    template = F.overlay(F.substr("seq", F.lit(1), F.lit(2 * layout.flank + 1)), F.lit("R"), F.lit(layout.flank + 1), F.lit(1))
    template = template if direction == "fwd" else S.revcomp_iupac(template)
    rows = genes.select(F.col("gene").alias("vid"), template.alias("template"), F.lit(direction).alias("direction"))
    picked = rows.select("*", *primers.pick_native(layout)).filter("left_start IS NOT NULL AND right_start IS NOT NULL")
    made = D.written(picked.select("vid", "direction", "primer_left", "primer_right", *primers.product(layout.flank)))
    both = made.select("vid", F.explode(F.array("primer_left", "primer_right")).alias("primer"))
    hits = primers.matches(both.select("primer"), chunks, 20)
    fine = both.join(hits, "primer").groupBy("vid").agg(F.max("hits").alias("hits")).filter("hits = 1")
    return made.join(fine.select("vid"), "vid", "left_semi")


@query("primer_designs")
def primer_designs(spark, d):
    """Each gene's forward design, or its reverse one where the forward one has no primers that
    match in one place only."""
    genes = D.written(R.spread(D.genes(spark, d)).select("gene", F.expr(_BASES).alias("seq")))
    starts = F.explode(F.sequence(F.lit(1), F.length("seq"), F.lit(400))).alias("at")
    chunks = genes.select("seq", starts).select(F.substr("seq", F.col("at"), F.lit(400 + 20 - 1)).alias("chunk_seq"))
    forward = D.written(_designs(genes, chunks, "fwd"))
    rest = genes.join(forward.select(F.col("vid").alias("gene")), "gene", "left_anti")
    return primers.best_direction(forward, _designs(rest, chunks, "rev"))


def _gene_bases(spark, d):
    return D.written(R.spread(D.genes(spark, d)).select("gene", F.expr(_BASES).alias("seq")))


#: Fixed pairs of each gene: 20 bases before and behind its base 401.
_LEFT, _RIGHT = ("substr(seq, CAST(351 + gene % 13 AS INT), 20)", "substr(seq, CAST(640 + gene % 17 AS INT), 20)")
_SEED, _MISMATCHES, _LONGEST = 10, 4, 400


@query(
    "off_targets",
    f"WITH {D.GENE_CTE}, q AS MATERIALIZED (SELECT gene, translate(array_to_string(list_transform(range(1, 27), lambda i: md5(gene || ':' || i)), ''), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM genes), "
    f"pr AS MATERIALIZED (SELECT gene AS vid, {_LEFT} AS l, translate(reverse({_RIGHT}), 'ACGT', 'TGCA') AS r FROM q), "
    "pp AS (SELECT DISTINCT primer FROM (SELECT l AS primer FROM pr UNION ALL SELECT r FROM pr)), "
    f"pt AS MATERIALIZED (SELECT primer, '+' AS strand, primer AS pattern, 20 - {_SEED} AS ahead FROM pp UNION ALL SELECT primer, '-', translate(reverse(primer), 'ACGT', 'TGCA'), 0 FROM pp), "
    f"w AS (SELECT gene, seq, i, substr(seq, i, {_SEED}) AS word FROM (SELECT gene, seq, unnest(range(1, length(seq) - {_SEED - 2})) AS i FROM q)), "
    f"h AS MATERIALIZED (SELECT primer, strand, gene, i - ahead AS s, i - ahead + 19 AS e FROM w JOIN pt ON word = substr(pattern, ahead + 1, {_SEED}) WHERE i > ahead AND i - ahead + 19 <= length(seq) AND list_sum(list_transform(range(1, 21), lambda k: CAST(substr(seq, i - ahead + k - 1, 1) <> substr(pattern, k, 1) AS INT))) <= {_MISMATCHES}), "
    "o AS (SELECT DISTINCT vid, p FROM (SELECT vid, l AS p FROM pr UNION ALL SELECT vid, r FROM pr)), "
    f"m AS (SELECT a.vid, count(*) AS n FROM (SELECT * FROM o JOIN h ON p = primer WHERE strand = '+') a JOIN (SELECT * FROM o JOIN h ON p = primer WHERE strand = '-') b ON a.vid = b.vid AND a.gene = b.gene AND a.s <= b.s AND a.e <= b.e AND b.e - a.s < {_LONGEST} GROUP BY a.vid), "
    "c AS (SELECT primer, count(*) AS n FROM h GROUP BY primer) "
    "SELECT pr.vid, coalesce(x.n, 0) AS left_hits, coalesce(y.n, 0) AS right_hits, coalesce(m.n, 0) AS products FROM pr LEFT JOIN m ON m.vid = pr.vid LEFT JOIN c x ON x.primer = l LEFT JOIN c y ON y.primer = r",
)
def off_targets_of_pairs(spark, d):
    """A fixed pair for each gene: where it binds in all genes' sequences, what it amplifies."""
    rows = _gene_bases(spark, d)
    pairs = rows.select(F.col("gene").alias("vid"), F.expr(_LEFT).alias("primer_left"), S.revcomp(F.expr(_RIGHT)).alias("primer_right"))
    parts = off_targets.windows(rows.select(F.col("gene").alias("chrom"), "seq"), 400, 20)
    return off_targets.specificity(pairs, parts, _LONGEST, _SEED, _MISMATCHES)


@query("primer_pairs")
def primer_pairs_of_genes(spark, d):
    """The best pair around base 401 of each gene, forward or else reverse, that amplifies one
    product in all genes' sequences."""
    layout, rows = primers.Layout(), _gene_bases(spark, d)
    template = F.overlay(F.substr("seq", F.lit(1), F.lit(2 * layout.flank + 1)), F.lit("R"), F.lit(layout.flank + 1), F.lit(1))
    parts = off_targets.windows(rows.select(F.col("gene").alias("chrom"), "seq"), 400, 28)

    def designs(genes, way, template):
        asked = genes.select(F.col("gene").alias("vid"), F.lit(way).alias("direction"), template.alias("template"))
        picked = D.written(primer_pairs.pick_pairs(R.spread(asked), layout).filter("primer_left IS NOT NULL"))
        one = off_targets.specificity(picked, parts, layout.product_max).filter("products = 1").select("vid")
        fine = picked.join(one, "vid", "left_semi").withColumn("penalty", F.round("penalty", 6))
        return fine.select("vid", "direction", "left_start", "right_start", "primer_left", "primer_right", "penalty")

    # Pairs cost most, so the other direction is only looked at where the first one has none.
    forward = D.written(designs(rows, "fwd", template))
    rest = rows.join(forward.select(F.col("vid").alias("gene")), "gene", "left_anti")
    return primers.best_direction(forward, designs(rest, "rev", S.revcomp_iupac(template)))
