"""Genetic data as projections of the driver's tables.

Each projection is one select list that both engines understand; the queries and their
SQL start from the same rows and are independent from there on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segspark.sources.scratch import scratch, written  # noqa: F401

SNPS = """
l_returnflag || l_linestatus AS chrom, l_orderkey * 1000 + l_linenumber AS pos,
substr('ACGT', CAST(1 + l_partkey % 4 AS INT), 1) AS ref, substr('ACGT', CAST(1 + l_suppkey % 4 AS INT), 1) AS alt,
CAST(l_quantity AS INT) AS res_major, CAST(round(l_tax * 100) AS INT) AS res_minor,
CAST(round(l_discount * 100) AS INT) + 5 AS sus_major, CAST(l_partkey % 40 AS INT) AS sus_minor,
l_extendedprice AS qual, l_tax AS hapsc, CAST(l_linenumber AS INT) AS lineno,
CASE WHEN l_partkey % 3 = 0 THEN '0|0' WHEN l_partkey % 3 = 1 THEN '0/1' ELSE '1/1' END AS geno_res,
CASE WHEN l_suppkey % 3 = 0 THEN '1|1' WHEN l_suppkey % 3 = 1 THEN '0|1' ELSE '0/0' END AS geno_sus,
CASE WHEN l_orderkey % 2 = 0 THEN '0|0' ELSE '1|1' END AS parent1, CASE WHEN l_partkey % 2 = 0 THEN '1|1' ELSE '0|1' END AS parent2,
l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey % 100000000 AS vid
"""

#: Small indels and SNPs: the reference or the alternative gets up to five more bases.
VARIANTS = """
l_returnflag || l_linestatus AS chrom, l_orderkey * 1000 + l_linenumber AS pos,
substr('ACGTACGTAC', CAST(1 + l_partkey % 4 AS INT), CASE WHEN l_suppkey % 5 = 1 THEN CAST(2 + l_partkey % 5 AS INT) ELSE 1 END) AS ref,
substr('ACGTACGTAC', CAST(1 + (l_partkey + 1 + l_suppkey % 3) % 4 AS INT), CASE WHEN l_suppkey % 5 = 2 THEN CAST(2 + l_partkey % 5 AS INT) ELSE 1 END) AS alt,
CASE WHEN l_linenumber % 3 = 0 THEN 'PASS' WHEN l_linenumber % 3 = 1 THEN 'LowQual' ELSE 'SnpCluster;LowQual' END AS filter
"""

GENES = """
p_partkey AS gene, substr('AFNOROAONFRF', CAST(1 + 2 * (p_partkey % 6) AS INT), 2) AS chrom,
p_partkey * 7500 AS g_start, p_partkey * 7500 + p_size * 100 - 1 AS g_end,
CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand
"""

#: Three exons of a sixth of the gene each, of whole codons together.
EXON = "g_start + CAST(floor((g_end - g_start + 1) / 3.0) AS BIGINT) * k AS e_start, g_start + CAST(floor((g_end - g_start + 1) / 3.0) AS BIGINT) * k + CAST(floor((g_end - g_start + 1) / 6.0) AS BIGINT) - 1 AS e_end"

#: A sequence for each gene, from the digits of a hash.
DNA = "repeat(translate(md5(CAST(gene AS VARCHAR(20))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 200)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_files(lines: DataFrame, path_only: bool = False) -> DataFrame | str:
    """Lines (``value``) as text files in the shared folder, and a scan of them, or their path:
    what a reader of genomics files starts from."""
    path = scratch(lines.sparkSession, "lines")
    lines.write.text(path)
    return path if path_only else lines.sparkSession.read.text(path)


def _columns(text: str) -> list[str]:
    """The select list cut at the commas outside brackets and quotes."""
    out, depth, part, quoted = [], 0, "", False
    for c in text:
        quoted ^= c == "'"
        depth += ((c == "(") - (c == ")")) * (not quoted)
        if c == "," and not depth and not quoted:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


def project(df: DataFrame, text: str, *keep: str) -> DataFrame:
    return df.selectExpr(*keep, *_columns(text))


def snps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    rows = project(table(spark, sf_dir, "lineitem"), SNPS)
    alleles = F.array("ref", "alt")
    flags = F.when(F.col("lineno") % 3 == 0, F.array(F.lit("PASS"))).when(F.col("lineno") % 3 == 1, F.array(F.lit("PASS"), F.lit("LOWQUAL"))).otherwise(F.array(F.lit("LOWQUAL")))
    return rows.withColumn("alleles_res", alleles).withColumn("alleles_sus", alleles).withColumn("flags", flags)


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct variants, told apart by ``vid``."""
    rows = project(table(spark, sf_dir, "lineitem"), VARIANTS).distinct()
    return rows.selectExpr("*", "concat_ws(':', chrom, pos, ref, alt, filter) AS vid")


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(table(spark, sf_dir, "part"), GENES)


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = genes(spark, sf_dir).selectExpr("*", "explode(sequence(0, 2)) AS k")
    return project(rows, EXON, "gene", "chrom", "g_start", "g_end", "strand").filter("e_start <= e_end")


SNP_CTE = f"snps AS (SELECT {SNPS} FROM lineitem)"
VARIANT_CTE = f"variants AS (SELECT *, concat_ws(':', chrom, pos, ref, alt, filter) AS vid FROM (SELECT DISTINCT {VARIANTS} FROM lineitem))"
GENE_CTE = f"genes AS (SELECT {GENES} FROM part)"
EXON_CTE = f"{GENE_CTE}, exons AS (SELECT gene, chrom, g_start, g_end, strand, {EXON} FROM genes, (SELECT unnest([0, 1, 2]) AS k))"
