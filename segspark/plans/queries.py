"""One query for each operator, over the projections in plans.domain, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.functions import sequence as S
from segspark.functions import stats as T
from segspark.operators import assays, bins, consequence, expressions, mapping, normalise, overlap, primers, quality, variants
from segspark.plans import domain as D
from segspark.sources import text as R
from segspark.sources.sinks import pooled_line, tabbed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


KEY = ["chrom", "pos", "vid"]

# ---- filters of pooled SNPs


@query("region_filter", f"WITH {D.SNP_CTE} SELECT chrom, pos, vid FROM snps WHERE chrom = 'RF' AND pos >= 1000000 AND pos <= 9000000")
def region_filter(spark, d):
    return D.snps(spark, d).filter(quality.in_region("RF", 1_000_000, 9_000_000)).select(*KEY)


@query("flag_filter", f"WITH {D.SNP_CTE} SELECT chrom, pos, vid FROM snps WHERE lineno % 3 = 0 AND qual >= 30000")
def flag_filter(spark, d):
    return D.snps(spark, d).filter(quality.legal_flags("pass") & (F.col("qual") >= 30000)).select(*KEY)


@query("hapsc_filter", f"WITH {D.SNP_CTE} SELECT chrom, pos, vid, hapsc FROM snps WHERE hapsc <= 0.03")
def hapsc_filter(spark, d):
    return D.snps(spark, d).filter("hapsc <= 0.03").select(*KEY, "hapsc")


#: Alleles of the pools that differ, are unknown or missing in some SNPs.
ALLELES = {
    "r1": "CASE WHEN sus_minor % 7 = 0 THEN 'N' ELSE ref END",
    "r2": "CASE WHEN sus_minor % 14 = 0 THEN 'N' WHEN res_minor = 3 THEN '-' ELSE alt END",
    "s1": "CASE WHEN sus_minor % 5 = 0 THEN alt WHEN sus_minor % 7 = 0 THEN 'N' ELSE ref END",
    "s2": "CASE WHEN sus_minor % 11 = 0 THEN '-' WHEN sus_minor % 13 = 0 THEN 'N' WHEN lineno = 5 THEN ref ELSE alt END",
}


@query("allele_filters", f"WITH {D.SNP_CTE}, a AS (SELECT *, {', '.join(f'{x} AS {c}' for c, x in ALLELES.items())} FROM snps) SELECT chrom, pos, vid, r1 || r2 || s1 || s2 AS alleles, r2 = s2 AS minor_too FROM a WHERE NOT (r1 = 'N' AND r2 = 'N') AND NOT (s1 = 'N' AND s2 = 'N') AND '-' NOT IN (r1, r2, s1, s2) AND r1 = s1")
def allele_filters(spark, d):
    rows = D.snps(spark, d).withColumns({c: F.expr(x) for c, x in ALLELES.items()})
    rows = rows.withColumn("alleles_res", F.array("r1", "r2")).withColumn("alleles_sus", F.array("s1", "s2"))
    keep = quality.no_missing_allele() & quality.no_dash() & quality.same_allele(0)
    return rows.filter(keep).select(*KEY, F.concat("r1", "r2", "s1", "s2").alias("alleles"), quality.same_allele(1).alias("minor_too"))


MEDIANS = "m AS (SELECT quantile_cont(res_major + res_minor, 0.5) AS mr, quantile_cont(sus_major + sus_minor, 0.5) AS ms FROM snps)"
BAND = "abs(res_major + res_minor - mr) < 0.5 * mr AND abs(sus_major + sus_minor - ms) < 0.5 * ms"


@query("coverage_median", f"WITH {D.SNP_CTE}, {MEDIANS} SELECT CAST(mr AS DOUBLE) AS median_res, CAST(ms AS DOUBLE) AS median_sus FROM m")
def coverage_median(spark, d):
    return quality.medians(D.snps(spark, d))


@query("coverage_band", f"WITH {D.SNP_CTE}, {MEDIANS} SELECT chrom, pos, vid FROM snps, m WHERE {BAND}")
def coverage_band(spark, d):
    return quality.coverage_band(D.snps(spark, d), 0.5).select(*KEY)


@query("parent_segregation", f"WITH {D.SNP_CTE} SELECT chrom, pos, vid FROM snps WHERE (parent1, parent2) IN (('0|0', '1|1'), ('1|1', '0|0'))")
def parent_segregation(spark, d):
    return D.snps(spark, d).filter(quality.parents_segregate()).select(*KEY)


FACTOR = "f AS (SELECT sum(res_major + res_minor) AS r, sum(sus_major + sus_minor) AS s FROM snps)"


@query("library_factor", f"WITH {D.SNP_CTE}, {FACTOR} SELECT CAST(r AS BIGINT) AS res_sum, CAST(s AS BIGINT) AS sus_sum, CAST(r AS DOUBLE) / CAST(s AS DOUBLE) AS factor FROM f")
def library_factor(spark, d):
    return quality.library_factors(D.snps(spark, d))


BOTH = f"{FACTOR}, both_ AS (SELECT snps.*, CAST(r AS DOUBLE) / CAST(s AS DOUBLE) * res_major + sus_major AS both_major, CAST(r AS DOUBLE) / CAST(s AS DOUBLE) * res_minor + sus_minor AS both_minor FROM snps, f)"


@query("counts_both", f"WITH {D.SNP_CTE}, {BOTH} SELECT chrom, pos, vid, round(both_major, 6) AS both_major, round(both_minor, 6) AS both_minor FROM both_")
def counts_both(spark, d):
    return quality.with_counts_both(D.snps(spark, d)).select(*KEY, F.round("both_major", 6).alias("both_major"), F.round("both_minor", 6).alias("both_minor"))


@query("ratio_filter", f"WITH {D.SNP_CTE}, {BOTH} SELECT chrom, pos, vid FROM both_ WHERE both_major / (both_major + both_minor) > 0.45 AND both_major / (both_major + both_minor) < 0.73")
def ratio_filter(spark, d):
    return quality.with_counts_both(D.snps(spark, d)).filter(quality.allele_ratio()).select(*KEY)


@query("trust_genotypes", f"WITH {D.SNP_CTE} SELECT chrom, pos, vid, CASE WHEN geno_res IN ('0|0', '1/1') THEN 0 ELSE res_minor END AS res_minor, CASE WHEN geno_sus IN ('1|1', '0/0') THEN 0 ELSE sus_minor END AS sus_minor FROM snps")
def trust_genotypes(spark, d):
    return quality.trust_genotypes(D.snps(spark, d)).select(*KEY, "res_minor", "sus_minor")


@query(
    "old_quality_filter",
    f"WITH {D.SNP_CTE} SELECT chrom, pos, vid FROM snps WHERE sus_major + sus_minor > 8 AND sus_major + sus_minor < 300 AND res_major + res_minor > 8 AND res_major + res_minor < 300 AND lineno % 2 = 0 AND res_major > 8 AND sus_major > 8",
)
def old_quality_filter(spark, d):
    old = {"sus_n1": F.col("sus_major"), "sus_n2": F.col("sus_minor"), "res_n1": F.col("res_major"), "res_n2": F.col("res_minor")}
    second = F.when(F.col("lineno") % 2 == 0, "N").otherwise("A")
    for name, n in (("um", "res_major"), ("tn1", "sus_major")):
        old |= {f"{name}_a2": second, f"{name}_n1": F.col(n), f"{name}_n2": F.lit(0)}
    return D.snps(spark, d).withColumns(old).filter(quality.depth_and_parents()).select(*KEY)


PREPROCESSED = f"kept AS (SELECT snps.* FROM snps, m WHERE hapsc <= 0.06 AND lineno % 3 = 0 AND parent1 <> parent2 AND parent2 = '1|1' AND {BAND})"


@query(
    "preprocess",
    f"WITH {D.SNP_CTE}, {MEDIANS}, {PREPROCESSED}, f AS (SELECT CAST(sum(res_major + res_minor) AS DOUBLE) / CAST(sum(sus_major + sus_minor) AS DOUBLE) AS l FROM kept) "
    "SELECT chrom, pos, vid, round(l * res_major + sus_major, 6) AS both_major FROM kept, f",
)
def preprocess(spark, d):
    return quality.preprocess(D.snps(spark, d), max_hapsc=0.06).select(*KEY, F.round("both_major", 6).alias("both_major"))


# ---- aggregates and bins


@query(
    "bin_sum",
    f"WITH {D.SNP_CTE}, t AS (SELECT chrom, max(pos) AS top FROM snps GROUP BY chrom), b AS (SELECT t.chrom, unnest(range(0, CAST(ceil(top / 100000.0) AS BIGINT))) AS bin FROM t) "
    "SELECT b.chrom, bin, min(pos) AS bin_pos, count(*) AS n, CAST(sum(res_major) AS BIGINT) AS res_major, CAST(sum(sus_major) AS BIGINT) AS sus_major FROM b JOIN snps ON snps.chrom = b.chrom AND pos >= bin * 100000 AND pos < bin * 100000 + 400000 GROUP BY b.chrom, bin",
)
def bin_sum(spark, d):
    return bins.position_bins(D.snps(spark, d), ["res_major", "sus_major"], 400_000, 100_000)


@query(
    "bin_mean",
    f"WITH {D.SNP_CTE}, t AS (SELECT chrom, max(pos) AS top FROM snps GROUP BY chrom), b AS (SELECT t.chrom, unnest(range(0, CAST(ceil(top / 250000.0) AS BIGINT))) AS bin FROM t) "
    "SELECT b.chrom, bin, min(pos) AS bin_pos, count(*) AS n, round(avg(sus_minor), 6) AS sus_minor FROM b JOIN snps ON snps.chrom = b.chrom AND pos >= bin * 250000 AND pos < bin * 250000 + 500000 GROUP BY b.chrom, bin",
)
def bin_mean(spark, d):
    return bins.position_bins(D.snps(spark, d), ["sus_minor"], 500_000, 250_000, mean=True).withColumn("sus_minor", F.round("sus_minor", 6))


@query(
    "bin_fixed_n",
    f"WITH {D.SNP_CTE} SELECT chrom, bin, round(avg(pos), 3) AS bin_pos, count(*) AS n, CAST(sum(res_major) AS BIGINT) AS res_major FROM (SELECT *, (row_number() OVER (PARTITION BY chrom ORDER BY pos, vid, res_major, qual) - 1) // 50 AS bin FROM snps) GROUP BY chrom, bin",
)
def bin_fixed_n(spark, d):
    return bins.row_bins(D.snps(spark, d), ["res_major"], 50, ties=("vid", "res_major", "qual")).withColumn("bin_pos", F.round("bin_pos", 3))


@query(
    "hom_het_bins",
    f"WITH {D.SNP_CTE}, t AS (SELECT chrom, max(pos) AS top FROM snps GROUP BY chrom), b AS (SELECT t.chrom, unnest(range(0, CAST(ceil(top / 100000.0) AS BIGINT))) AS bin FROM t) "
    "SELECT b.chrom, bin, min(pos) AS bin_pos, count(*) AS n, round(count(*) FILTER (WHERE geno_res <> '0/1') / count(*), 6) AS hom, round(1 - count(*) FILTER (WHERE geno_res <> '0/1') / count(*), 6) AS het FROM b JOIN snps ON snps.chrom = b.chrom AND pos >= bin * 100000 AND pos < bin * 100000 + 100000 GROUP BY b.chrom, bin",
)
def hom_het_bins(spark, d):
    rows = bins.call_shares(D.snps(spark, d), normalise.is_homozygous(F.col("geno_res")), 100_000, 100_000)
    return rows.withColumn("hom", F.round("hom", 6)).withColumn("het", F.round("het", 6))


@query("row_windows", f"WITH {D.SNP_CTE} SELECT chrom, pos, vid, qual, CAST(sum(res_major) OVER (PARTITION BY chrom ORDER BY pos, vid, res_major, qual ROWS BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS BIGINT) AS window_res_major FROM snps")
def row_windows(spark, d):
    rows = D.snps(spark, d).select("chrom", "pos", "vid", "qual", "res_major")
    return bins.row_windows(rows, ["res_major"], 100, ties=("vid", "res_major", "qual"), block=2000).drop("res_major")


@query("expected_window", f'WITH {D.SNP_CTE} SELECT chrom, round((max(pos) - min(pos)) / (2.0::DOUBLE * 458), 6) AS "window" FROM snps GROUP BY chrom')
def expected_window(spark, d):
    return bins.expected_window(D.snps(spark, d), 458).withColumn("window", F.round("window", 6))


@query("average_dp", f"WITH {D.SNP_CTE} SELECT chrom, round(CAST(sum(res_minor) AS DOUBLE) / CAST(count(*) FILTER (WHERE res_minor > 0) AS DOUBLE), 6) AS average FROM snps GROUP BY chrom")
def average_dp(spark, d):
    return D.snps(spark, d).groupBy("chrom").agg(F.round(normalise.average_depth("res_minor"), 6).alias("average"))


@query("position_span", f"WITH {D.SNP_CTE} SELECT chrom, min(pos) AS first, max(pos) AS last, count(*) AS n FROM snps GROUP BY chrom")
def position_span(spark, d):
    return D.snps(spark, d).groupBy("chrom").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n"))


# ---- statistics


@query("log_binomial", f"WITH {D.SNP_CTE} SELECT vid, res_major, qual, round(res_major * ln(0.99) + res_minor * ln(1 - 0.99), 6) AS ll FROM snps")
def log_binomial(spark, d):
    return D.snps(spark, d).select("vid", "res_major", "qual", F.round(T.log_binomial(F.col("res_major"), F.col("res_major") + F.col("res_minor"), 0.99), 6).alias("ll"))


@query("ln_choose", f"WITH {D.SNP_CTE} SELECT DISTINCT res_major AS n, least(res_major, sus_minor) AS k, round(lgamma(res_major + 1) - lgamma(least(res_major, sus_minor) + 1) - lgamma(res_major - least(res_major, sus_minor) + 1), 6) + 0 AS v FROM snps")
def ln_choose(spark, d):
    rows = D.snps(spark, d).select(F.col("res_major").alias("n"), F.least("res_major", "sus_minor").alias("k")).distinct()
    return rows.select("n", "k", (F.round(T.ln_choose("n", "k"), 6) + 0).alias("v"))


@query(
    "segregation_pvalue",
    f"WITH {D.SNP_CTE}, p AS (SELECT DISTINCT sus_major AS k, sus_major + sus_minor AS n FROM snps) SELECT k, n, round(least(1.0, 2 * list_sum(list_transform(range(0, least(k, n - k) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0))))), 8) AS p FROM p",
)
def segregation_pvalue(spark, d):
    rows = D.snps(spark, d).select(F.col("sus_major").alias("k"), (F.col("sus_major") + F.col("sus_minor")).alias("n")).distinct()
    return rows.select("k", "n", F.round(T.binomial_p_value(F.col("k"), F.col("n")), 8).alias("p"))


#: The locus that distances of SNPs are taken from.
LOCUS = 7_000_000
FAR = f"greatest(1, abs(pos - {LOCUS}))"
PODD = f"d AS (SELECT chrom, pos, vid, {FAR} AS distance FROM snps), p AS (SELECT *, 0.5 * (1 - exp(-2.0 * distance * 7.3e-8)) AS podd FROM d)"


def _podd(spark, d):
    rows = D.snps(spark, d).select("chrom", "pos", "vid", F.greatest(F.lit(1), F.abs(F.col("pos") - LOCUS)).alias("distance"))
    return rows, T.odd_crossovers(F.col("distance"), 7.3e-8)


@query("podd_curve", f"WITH {D.SNP_CTE}, {PODD} SELECT chrom, pos, vid, round(podd, 10) AS podd, round(podd * (1 - podd) / 178, 12) AS variance FROM p")
def podd_curve(spark, d):
    rows, podd = _podd(spark, d)
    return rows.select("chrom", "pos", "vid", F.round(podd, 10).alias("podd"), F.round(T.odd_variance(podd, F.lit(178.0)), 12).alias("variance"))


@query(
    "expected_curve",
    f"WITH {D.SNP_CTE}, p AS (SELECT chrom, pos, vid, 0.5 * (1 - exp(-2.0 * abs(pos - {LOCUS + 100000}.0) * 3.69e-8)) AS podd FROM snps) "
    "SELECT chrom, pos, vid, round(0.98 - podd, 8) AS rate, round(0.98 - podd - sqrt(podd * (1 - podd) / 178), 8) AS low, round(0.98 - podd + sqrt(podd * (1 - podd) / 178), 8) AS high FROM p",
)
def expected_curve(spark, d):
    rows = D.snps(spark, d).select("chrom", "pos", "vid", *T.expected_at(F.col("pos"), LOCUS, 3.69e-8, 178.0))
    return rows.select("chrom", "pos", "vid", *(F.round(c, 8).alias(c) for c in ("rate", "low", "high")))


@query("ideal_curves", f"WITH {D.SNP_CTE}, c AS (SELECT chrom, pos, vid, (pos - {LOCUS}) / 1000000.0::DOUBLE AS x FROM snps) SELECT chrom, pos, vid, round(0.5 + 0.5 * exp(-abs(x)), 8) AS res, round(0.5 - 0.2 * exp(-abs(x)), 8) AS sus FROM c")
def ideal_curves(spark, d):
    rows = D.snps(spark, d).select("chrom", "pos", "vid", *T.ideal_at((F.col("pos") - LOCUS) / 1e6))
    return rows.select("chrom", "pos", "vid", *(F.round(c, 8).alias(c) for c in ("res", "sus")))


BETA = "b AS (SELECT *, (1 - podd) * ((1 - podd) * podd / (podd * (1 - podd) / 178 + 1e-8) - 1) AS ra, podd * ((1 - podd) * podd / (podd * (1 - podd) / 178 + 1e-8) - 1) AS rb, (1 + podd) / 3 * ((1 + podd) / 3 * (1 - (1 + podd) / 3) / (podd * (1 - podd) / 840 + 1e-8) - 1) AS sa, (1 - (1 + podd) / 3) * ((1 + podd) / 3 * (1 - (1 + podd) / 3) / (podd * (1 - podd) / 840 + 1e-8) - 1) AS sb FROM p)"


@query("beta_params", f"WITH {D.SNP_CTE}, {PODD}, {BETA} SELECT chrom, pos, vid, round(ra, 4) AS ra, round(rb, 4) AS rb, round(sa, 4) AS sa, round(sb, 4) AS sb, round(ra / (ra + rb), 8) AS mean, round(ra * rb / ((ra + rb) * (ra + rb) * (ra + rb + 1)), 10) AS variance FROM b")
def beta_params(spark, d):
    rows, podd = _podd(spark, d)
    (ra, rb), (sa, sb) = T.beta_params(podd, "res", 178.0, 1e-4), T.beta_params(podd, "sus", 280.0, 1e-4)
    made = rows.select(*KEY, ra.alias("ra"), rb.alias("rb"), sa.alias("sa"), sb.alias("sb"))
    mean, variance = T.beta_moments(F.col("ra"), F.col("rb"))
    return made.select(*KEY, *(F.round(c, 4).alias(c) for c in ("ra", "rb", "sa", "sb")), F.round(mean, 8).alias("mean"), F.round(variance, 10).alias("variance"))


RISE = "list_sum(list_transform(range(0, {k}), lambda i: ln({x} + i)))"


def _lbb(k: str, n: str, a: str, b: str) -> str:
    return "(" + " - ".join([" + ".join(f"coalesce({RISE.format(k=kk, x=x)}, 0)" for kk, x in ((k, a), (f"{n} - {k}", b))), f"coalesce({RISE.format(k=n, x=f'({a} + {b})')}, 0)"]) + ")"


@query("log_beta_binomial", f"WITH {D.SNP_CTE}, p AS (SELECT DISTINCT res_major AS k, res_major + res_minor AS n FROM snps) SELECT k, n, round({_lbb('k', 'n', '12.5', '0.75')}, 6) AS ll FROM p")
def log_beta_binomial(spark, d):
    rows = D.snps(spark, d).select(F.col("res_major").alias("k"), (F.col("res_major") + F.col("res_minor")).alias("n")).distinct()
    return rows.select("k", "n", F.round(T.log_beta_binomial("k", "n", F.lit(12.5), F.lit(0.75)), 6).alias("ll"))


@query(
    "binomial_test_lod",
    f"WITH {D.SNP_CTE} SELECT vid, qual, res_major, round(res_major * ln(0.99) + res_minor * ln(1 - 0.99) - (res_major + res_minor) * ln(0.5) + sus_major * ln(0.33) + sus_minor * ln(1 - 0.33) - (sus_major + sus_minor) * ln(0.5), 5) AS score, round(res_major * ln(0.99) + res_minor * ln(1 - 0.99) - (res_major + res_minor) * ln(0.5), 5) AS score_res, round(sus_major * ln(0.33) + sus_minor * ln(1 - 0.33) - (sus_major + sus_minor) * ln(0.5), 5) AS score_sus FROM snps",
)
def binomial_test_lod(spark, d):
    return D.snps(spark, d).select("vid", "qual", "res_major", *mapping.binomial_lod()).select("vid", "qual", "res_major", *(F.round(c, 5).alias(c) for c in ("score", "score_res", "score_sus")))


PHASES = "ph AS (SELECT *, res_major * ln(0.99) + res_minor * ln(1 - 0.99) + sus_major * ln(0.33) + sus_minor * ln(1 - 0.33) AS l1, res_minor * ln(0.99) + res_major * ln(1 - 0.99) + sus_minor * ln(0.33) + sus_major * ln(1 - 0.33) AS l2, (res_major + res_minor + sus_major + sus_minor) * ln(0.5) AS lb FROM snps)"


@query("binomial_opt", f"WITH {D.SNP_CTE}, {PHASES} SELECT vid, qual, round(greatest(l1, l2), 5) AS l, round(lb, 5) AS lb, round(l1, 5) AS l1, round(l2, 5) AS l2 FROM ph")
def binomial_opt(spark, d):
    return D.snps(spark, d).select("vid", "qual", *mapping.binomial_opt()).select("vid", "qual", *(F.round(c, 5).alias(c) for c in ("l", "lb", "l1", "l2")))


@query("trivial_phasing", f"WITH {D.SNP_CTE} SELECT vid, qual, CASE WHEN res_minor > res_major THEN res_minor ELSE res_major END AS k_res, CASE WHEN res_minor > res_major THEN sus_minor ELSE sus_major END AS k_sus FROM snps")
def trivial_phasing(spark, d):
    return D.snps(spark, d).select("vid", "qual", *mapping.phased_counts(True))


# ---- mapping

RATES = "rt AS (SELECT 2.0::DOUBLE / (max(pos) - min(pos)) AS rate FROM snps)"
GRID = "g0 AS (SELECT chrom, min(pos) AS pmin, CAST(ceil((max(pos) - min(pos)) / 500000.0) AS BIGINT) AS points FROM snps GROUP BY chrom), g AS (SELECT chrom, pmin, unnest(range(0, points)) AS i FROM g0)"
FINE_GRID = GRID.replace("500000", "100000")


def _pair_sql(eps: str, scale: str) -> str:
    """Parameters of both pools from podd."""
    c_res = f"greatest((1 - podd) * podd / (podd * (1 - podd) / 178 + {eps} * {eps}) - 1, 1e-3)"
    c_sus = f"greatest((1 + podd) / 3 * (1 - (1 + podd) / 3) / (podd * (1 - podd) / 840 + {eps} * {eps}) - 1, 1e-3)"
    return f"(1 - podd) * {c_res} AS ra, podd * {c_res} AS rb, (1 + podd) / 3 * {c_sus} AS sa, (1 - (1 + podd) / 3) * {c_sus} AS sb"


def _ll() -> str:
    return _lbb("res_major", "(res_major + res_minor)", "ra", "rb") + " + " + _lbb("sus_major", "(sus_major + sus_minor)", "sa", "sb")


def _scored(where: str) -> str:
    return (
        f"{D.SNP_CTE}, {RATES}, {FINE_GRID}, "
        f"base AS (SELECT snps.*, {_pair_sql('1e-2', '1').replace('podd', '0.5::DOUBLE')} FROM snps), base_ll AS (SELECT chrom, pos, res_major, res_minor, sus_major, sus_minor, {_ll()} AS ll0 FROM base), "
        "pairs AS (SELECT g.chrom, g.i, b.res_major, b.res_minor, b.sus_major, b.sus_minor, b.ll0, 0.5 * (1 - exp(-2.0 * greatest(1, abs(g.pmin + g.i * 100000 - b.pos)) * rate)) AS podd "
        f"FROM g JOIN base_ll b ON g.chrom = b.chrom AND b.pos > g.pmin + g.i * 100000 - {where} AND b.pos < g.pmin + g.i * 100000 + {where}, rt), "
        f"pp AS (SELECT *, {_pair_sql('1e-4', '1')} FROM pairs), "
        f"sc AS (SELECT chrom, i, sum({_ll()} - ll0) AS s FROM pp GROUP BY chrom, i), "
        "score AS (SELECT g.chrom, g.pmin + g.i * 100000 AS pos, greatest(coalesce(s, 0), 0) AS score FROM g LEFT JOIN sc ON g.chrom = sc.chrom AND g.i = sc.i)"
    )


def _score(spark, d):
    return mapping.map_score(D.snps(spark, d), 178, 280, window=500_000)


@query("map_score", f"WITH {_scored('500000')} SELECT chrom, pos, round(score, 4) AS score FROM score")
def map_score(spark, d):
    return _score(spark, d).withColumn("score", F.round("score", 4))


@query("map_peak", f"WITH {_scored('500000')} SELECT chrom, arg_max(pos, (score, -pos)) AS pos, round(max(score), 4) AS score FROM score GROUP BY chrom")
def map_peak(spark, d):
    return mapping.peaks(_score(spark, d)).withColumn("score", F.round("score", 4))


@query("map_score_wide", f"WITH {_scored('5000000')} SELECT chrom, pos, round(score, 3) AS score FROM score")
def map_score_wide(spark, d):
    """With the default window of 5,000,000."""
    return mapping.map_score(D.snps(spark, d), 178, 280).withColumn("score", F.round("score", 3))


@query(
    "nearest_snp",
    f"WITH {D.SNP_CTE}, {GRID}, a AS (SELECT g.chrom, g.i, s.pos, abs(g.pmin + g.i * 500000 - s.pos) AS distance FROM g JOIN snps s ON s.chrom = g.chrom AND abs(g.pmin + g.i * 500000 - s.pos) < 200000) SELECT chrom, i, arg_min(pos, (distance, pos)) AS pos, min(distance) AS distance FROM a GROUP BY chrom, i",
)
def nearest_snp(spark, d):
    return mapping.nearest_snp(D.snps(spark, d), 500_000, 200_000)


@query("corrected_frequency", f"WITH {D.SNP_CTE}, {BOTH} SELECT vid, qual, res_major, round(both_major / (both_major + both_minor) / 0.66, 6) AS cf FROM both_")
def corrected_frequency(spark, d):
    return quality.with_counts_both(D.snps(spark, d)).select("vid", "qual", "res_major", F.round(mapping.corrected_frequency(), 6).alias("cf"))


@query("recombination_rate", f"WITH {D.SNP_CTE} SELECT chrom, round(1e9 * 2.0 / (max(pos) - min(pos)), 6) AS rate FROM snps GROUP BY chrom")
def recombination_rate(spark, d):
    return mapping.recombination_rate(D.snps(spark, d), per_chrom=True).select("chrom", F.round(F.col("rate") * 1e9, 6).alias("rate"))


@query("map_score_opt")
def map_score_opt(spark, d):
    return mapping.map_score_opt(D.snps(spark, d), 178, 280).withColumn("score", F.round("score", 4))


@query(
    "stepwise_binomial",
    f"WITH {D.SNP_CTE}, g0 AS (SELECT chrom, min(pos) AS pmin, CAST(ceil((max(pos) - min(pos)) / 500000.0) AS BIGINT) AS points FROM snps GROUP BY chrom), g AS (SELECT chrom, pmin, unnest(range(1, points + 1)) AS i FROM g0), "
    "pr AS (SELECT g.chrom, g.i, snps.*, least(greatest(1 - abs(pmin + g.i * 500000 - pos) / 400000.0::DOUBLE * 0.5, 0.5), 1 - 1e-12::DOUBLE) AS x, least(0.33::DOUBLE + abs(pmin + g.i * 500000 - pos) / 400000.0::DOUBLE * (0.5::DOUBLE - 0.33::DOUBLE), 0.5::DOUBLE) AS y FROM g JOIN snps ON g.chrom = snps.chrom AND abs(pmin + g.i * 500000 - pos) < 400000), "
    "r AS (SELECT chrom, i, sum(res_major * ln(x) + res_minor * ln(1 - x) - (res_major + res_minor) * ln(0.5) + sus_major * ln(y) + sus_minor * ln(1 - y) - (sus_major + sus_minor) * ln(0.5)) AS ratio FROM pr GROUP BY chrom, i) "
    "SELECT g.chrom, pmin + g.i * 500000 AS pos, round(coalesce(ratio, 0), 4) AS ratio, round(1 / (1 + exp(-coalesce(ratio, 0))), 6) AS posterior FROM g LEFT JOIN r ON g.chrom = r.chrom AND g.i = r.i",
)
def stepwise_binomial(spark, d):
    rows = mapping.stepwise_binomial(D.snps(spark, d), 400_000, step=500_000)
    return rows.select("chrom", "pos", F.round("ratio", 4).alias("ratio"), F.round("posterior", 6).alias("posterior"))


@query(
    "binned_ratios",
    f"WITH {D.SNP_CTE}, t AS (SELECT chrom, max(pos) AS top FROM snps GROUP BY chrom), b AS (SELECT t.chrom, unnest(range(0, CAST(ceil(top / 250000.0) AS BIGINT))) AS bin FROM t), "
    "s AS (SELECT chrom, pos, res_major * ln(0.9) + res_minor * ln(1 - 0.9) - (res_major + res_minor) * ln(0.5) AS sr, sus_major * ln(0.3) + sus_minor * ln(1 - 0.3) - (sus_major + sus_minor) * ln(0.5) AS ss FROM snps) "
    "SELECT b.chrom, bin, min(pos) AS bin_pos, count(*) AS n, round(sum(sr), 4) AS score_res, round(sum(ss), 4) AS score_sus, round(sum(sr + ss), 4) AS score FROM b JOIN s ON s.chrom = b.chrom AND pos >= bin * 250000 AND pos < bin * 250000 + 500000 GROUP BY b.chrom, bin",
)
def binned_ratios(spark, d):
    rows = mapping.binned_ratios(D.snps(spark, d), 500_000, 250_000)
    return rows.select("chrom", "bin", "bin_pos", "n", *(F.round(c, 4).alias(c) for c in ("score_res", "score_sus", "score")))


@query(
    "pooled_rate_peaks",
    f"WITH {D.SNP_CTE}, q AS (SELECT CAST(sum(res_major) AS DOUBLE) / sum(res_major + res_minor) AS r, CAST(sum(sus_major) AS DOUBLE) / sum(sus_major + sus_minor) AS s FROM snps), "
    "t AS (SELECT chrom, max(pos) AS top FROM snps GROUP BY chrom), b AS (SELECT t.chrom, unnest(range(0, CAST(ceil(top / 250000.0) AS BIGINT))) AS bin FROM t), "
    "l AS (SELECT chrom, pos, greatest(res_major * ln(r) + res_minor * ln(1 - r), res_minor * ln(r) + res_major * ln(1 - r)) - greatest(sus_major * ln(s) + sus_minor * ln(1 - s), sus_minor * ln(s) + sus_major * ln(1 - s)) AS peak, (res_major + res_minor + sus_major + sus_minor) * ln(0.5) AS bg FROM snps, q) "
    "SELECT b.chrom, bin, min(pos) AS bin_pos, count(*) AS n, round(sum(peak), 4) AS peak, round(sum(bg), 4) AS background FROM b JOIN l ON l.chrom = b.chrom AND pos >= bin * 250000 AND pos < bin * 250000 + 250000 GROUP BY b.chrom, bin HAVING sum(bg) > -6000",
)
def pooled_rate_peaks(spark, d):
    rows = mapping.pooled_rate_peaks(D.snps(spark, d), 250_000, 250_000)
    return rows.select("chrom", "bin", "bin_pos", "n", F.round("peak", 4).alias("peak"), F.round("background", 4).alias("background"))


def _uniform_sql(what: str) -> str:
    return f"CAST('0x' || substr(md5('1:' || chrom || ':' || pos || ':' || draw || ':{what}'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"


def _binomial_sql(source: str, n: int, name: str) -> str:
    """``name``: rows of ``source`` (r, q, u) with ``k``, how many cumulated probabilities stay below u."""
    term = f"CASE WHEN q <= 0 THEN CASE WHEN j = 0 THEN 1.0 ELSE 0.0 END WHEN q >= 1 THEN CASE WHEN j = {n} THEN 1.0 ELSE 0.0 END ELSE exp(lgamma({n + 1}) - lgamma(j + 1) - lgamma({n + 1} - j) + j * ln(q) + ({n} - j) * ln(1 - q)) END"
    return f"{name} AS (SELECT r, count(*) FILTER (below < u) AS k FROM (SELECT r, u, sum({term}) OVER (PARTITION BY r ORDER BY j) AS below FROM (SELECT r, q, u, unnest(range(0, {n})) AS j FROM {source})) GROUP BY r)"


@query(
    "simulate_pools",
    f"WITH {D.SNP_CTE}, w AS (SELECT DISTINCT chrom, pos FROM snps), d AS MATERIALIZED (SELECT *, row_number() OVER () AS r, abs(pos - {LOCUS}) AS distance FROM (SELECT chrom, pos, unnest([0, 1]) AS draw FROM w)), "
    f"a AS (SELECT r, greatest(0.5 * (1 - exp(-2.0 * distance * 2.0 / 17645844)), 0) AS q, {_uniform_sql('pool')} AS u FROM d), {_binomial_sql('a', 178, 'pk')}, "
    f"c AS (SELECT d.r, k / 178.0::DOUBLE AS q, {_uniform_sql('reads')} AS u FROM d JOIN pk ON d.r = pk.r), {_binomial_sql('c', 20, 'rk')} "
    "SELECT chrom, pos, CAST(draw AS INT) AS draw, distance, CAST(178 - pk.k AS INT) AS pool_count, CAST(20 - rk.k AS INT) AS read_count FROM d JOIN pk ON d.r = pk.r JOIN rk ON d.r = rk.r",
)
def simulate_pools(spark, d):
    """Two draws at each SNP's distance from a locus."""
    return mapping.simulate_pools(R.spread(D.snps(spark, d).select("chrom", "pos").distinct()), LOCUS, draws=2)


# ---- calls: parse, normalise, query

CALLS = """
l_returnflag || l_linestatus AS chrom, l_orderkey * 1000 + l_linenumber AS pos,
substr('ACGTACGTAC', CAST(1 + l_partkey % 4 AS INT), CASE WHEN l_suppkey % 7 = 1 THEN 3 ELSE 1 END) AS ref,
CASE WHEN l_suppkey % 11 = 0 THEN 'C,T' ELSE substr('ACGT', CAST(1 + l_suppkey % 4 AS INT), 1) END AS alt,
CAST(CAST(l_quantity AS INT) AS VARCHAR(10)) AS qual, CASE WHEN l_linenumber % 2 = 0 THEN 'PASS' ELSE 'LowQual' END AS filter,
CASE WHEN l_linenumber % 3 = 0 THEN 'DP=' || CAST(CAST(l_quantity AS INT) AS VARCHAR(10)) || ';SB=0.1' ELSE 'DP=' || CAST(CAST(l_quantity AS INT) AS VARCHAR(10)) END AS info,
CASE WHEN l_partkey % 3 = 0 THEN '0|1' WHEN l_partkey % 3 = 1 THEN '0/1' ELSE '1/1' END AS g1, CAST(l_quantity AS INT) AS a1, CAST(l_partkey % 40 AS INT) AS b1,
CASE WHEN l_suppkey % 3 = 0 THEN '1|1' WHEN l_suppkey % 3 = 1 THEN '0|1' ELSE '0/0' END AS g2, CAST(round(l_discount * 100) AS INT) AS a2, CAST(l_suppkey % 20 AS INT) AS b2,
l_linenumber % 5 = 0 AS gone
"""
SAMPLE1, SAMPLE2 = "concat(g1, ':', a1, ',', b1, ':', a1 + b1, ':99:1,2,3')", "concat(g2, ':', a2, ',', b2, ':', a2 + b2, ':50:4,5,6')"
CALL_CTE = f"calls AS (SELECT {CALLS} FROM lineitem)"
HEADER = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tres\tsus"


def _parsed(spark, d):
    """Calls as text lines, read back by the reader's projections."""
    rows = D.project(D.table(spark, d, "lineitem"), CALLS)
    line = F.concat_ws("\t", "chrom", "pos", F.lit("."), "ref", "alt", "qual", "filter", "info", F.lit("GT:AD:DP:GQ:PL"), F.expr(SAMPLE1), F.expr(f"CASE WHEN gone THEN './.' ELSE {SAMPLE2} END"))
    return R.parse_vcf(D.as_files(R.spread(rows).select(line.alias("value"))), ["res", "sus"])


@query(
    "vcf_parse",
    f"WITH {CALL_CTE} SELECT chrom || '@' || CAST(pos AS VARCHAR) AS key, chrom, pos, ref, string_split(alt, ',')[1] AS first_alt, CAST(qual AS DOUBLE) AS qual, CAST(qual AS INT) AS dp, CASE WHEN gone THEN 1 ELSE 2 END AS n_samples, g1 AS gt FROM calls",
)
def vcf_parse(spark, d):
    return _parsed(spark, d).select("key", "chrom", "pos", "ref", F.get("alt", F.lit(0)).alias("first_alt"), "qual", F.col("info")["DP"].cast("int").alias("dp"), F.size("samples").alias("n_samples"), variants.field_of(1, "GT").alias("gt"))


@query("variant_type", f"WITH {CALL_CTE} SELECT chrom, pos, CASE WHEN contains(alt, ',') THEN 'multi-allelic' WHEN length(ref) > 1 OR length(alt) > 1 THEN 'indel' WHEN ref <> alt THEN 'SNP' ELSE '.' END AS type, count(*) AS n FROM calls GROUP BY ALL")
def variant_type(spark, d):
    return _parsed(spark, d).groupBy("chrom", "pos", normalise.variant_type(F.col("ref"), F.col("alt")).alias("type")).agg(F.count("*").alias("n"))


DESIGN = normalise.Design("res", "sus")
SWITCH = "sw AS (SELECT *, a1 < b1 AND NOT contains(alt, ',') AS sw, contains(alt, ',') AS multi, NOT gone AS seen FROM calls)"


@query(
    "allele_switch",
    f"WITH {CALL_CTE}, {SWITCH} SELECT chrom, pos, CASE WHEN multi THEN NULL WHEN sw THEN alt ELSE ref END AS major, CASE WHEN multi THEN NULL WHEN sw THEN ref ELSE alt END AS minor, "
    "CASE WHEN sw THEN concat(CASE g1 WHEN '0|1' THEN '1|0' WHEN '0/1' THEN '0/1' ELSE '0/0' END, ':', b1, ',', a1, ':', a1 + b1, ':99:3,2,1') ELSE concat(g1, ':', a1, ',', b1, ':', a1 + b1, ':99:1,2,3') END AS res FROM sw",
)
def allele_switch(spark, d):
    return normalise.normalise(_parsed(spark, d), DESIGN).select("chrom", "pos", "major", "minor", "res")


@query(
    "segr_counts",
    f"WITH {CALL_CTE}, {SWITCH} SELECT chrom, pos, CASE WHEN seen THEN CASE WHEN sw THEN b1 + b2 ELSE a1 + a2 END END AS segr_major, CASE WHEN seen THEN CASE WHEN sw THEN a1 + a2 ELSE b1 + b2 END END AS segr_minor FROM sw",
)
def segr_counts(spark, d):
    return normalise.normalise(_parsed(spark, d), DESIGN).select("chrom", "pos", "segr_major", "segr_minor")


@query(
    "filter_annotate",
    f"WITH {CALL_CTE}, x AS (SELECT *, NOT contains(info, 'SB=') AS nosb, NOT gone AND g2 <> '0|1' AS hom FROM calls) "
    "SELECT chrom, pos, CASE WHEN NOT nosb AND NOT hom THEN filter ELSE concat_ws(';', nullif(filter, 'PASS'), CASE WHEN nosb THEN 'NoSBtag' END, CASE WHEN hom THEN 'NonPhasingPoolHomozygous' END) END AS filter FROM x",
)
def filter_annotate(spark, d):
    return normalise.normalise(_parsed(spark, d), DESIGN).select("chrom", "pos", F.array_join("filter", ";").alias("filter"))


@query(
    "pooled_lines",
    f"WITH {CALL_CTE}, {SWITCH}, l AS (SELECT chrom, pos, concat_ws(chr(9), chrom, pos, '.', ref, alt, CASE WHEN multi THEN 'NA' WHEN sw THEN alt ELSE ref END, CASE WHEN multi THEN 'NA' WHEN sw THEN ref ELSE alt END) AS line FROM sw) SELECT line, count(*) AS n FROM l GROUP BY line",
)
def pooled_lines(spark, d):
    rows = normalise.normalise(_parsed(spark, d), DESIGN).select(pooled_line(["res", "sus"]).alias("line"))
    return rows.groupBy(F.array_join(F.slice(F.split("line", "\t"), 1, 7), "\t").alias("line")).agg(F.count("*").alias("n"))


@query(
    "pcr_table",
    f"WITH {CALL_CTE} SELECT chrom, pos, ref, alt, a1 AS res_major, b1 AS res_minor, a1 + b1 AS res_dp, round(a1::DOUBLE / nullif(a1 + b1, 0), 8) AS res_major_share, CASE WHEN NOT gone THEN a2 END AS sus_major, CASE WHEN NOT gone THEN round(b2::DOUBLE / nullif(a2 + b2, 0), 8) END AS sus_minor_share FROM calls",
)
def pcr_table(spark, d):
    rows = normalise.pcr_table(_parsed(spark, d), ["res", "sus"])
    return rows.select("chrom", "pos", "ref", "alt", "res_major", "res_minor", "res_dp", F.round("res_major_share", 8).alias("res_major_share"), "sus_major", F.round("sus_minor_share", 8).alias("sus_minor_share"))


@query("expr_filter", f"WITH {CALL_CTE} SELECT chrom, pos, ref FROM calls WHERE CAST(qual AS INT) > 30 AND ref <> 'A' AND CAST(qual AS INT) % 2 = 0 AND chrom <> 'AF'")
def expr_filter(spark, d):
    return variants.filtered(_parsed(spark, d), "qual > 30 AND ref <> 'A' AND CAST(info['DP'] AS INT) % 2 = 0 AND chrom <> 'AF'", ["chrom", "pos", "ref"])


def _dp(s):
    return variants.tag(s, "DP", "int")


@query("samples_any", f"WITH {CALL_CTE} SELECT chrom, pos FROM calls WHERE a1 + b1 > 70 OR (NOT gone AND a2 + b2 > 25)")
def samples_any(spark, d):
    return _parsed(spark, d).filter(variants.any_sample(lambda s: ((s["name"] == "res") & (_dp(s) > 70)) | ((s["name"] == "sus") & (_dp(s) > 25)))).select("chrom", "pos")


@query("samples_all", f"WITH {CALL_CTE} SELECT chrom, pos FROM calls WHERE a1 + b1 > 15 AND (gone OR a2 + b2 > 15)")
def samples_all(spark, d):
    return _parsed(spark, d).filter(variants.all_samples(lambda s: _dp(s) > 15)).select("chrom", "pos")


@query("samples_atleast", f"WITH {CALL_CTE} SELECT chrom, pos FROM calls WHERE g1 IN ('0/1', '0|1') AND NOT gone AND g2 = '0|1'")
def samples_atleast(spark, d):
    return _parsed(spark, d).filter(variants.at_least(2, lambda s: ~normalise.is_homozygous(variants.tag(s, "GT")))).select("chrom", "pos")


@query("forsample", f"WITH {CALL_CTE} SELECT chrom, pos FROM calls WHERE NOT gone AND a2 + b2 > 20")
def forsample(spark, d):
    return _parsed(spark, d).filter(variants.for_sample(2, lambda s: _dp(s) > 20)).select("chrom", "pos")


@query("crosscomp", f"WITH {CALL_CTE} SELECT chrom, pos FROM calls WHERE NOT gone AND a1 + b1 < a2 + b2")
def crosscomp(spark, d):
    return _parsed(spark, d).filter(variants.compare(1, 2, lambda a, b: _dp(a) < _dp(b))).select("chrom", "pos")


#: Expressions of one filter, and the same in SQL.
EXPRESSIONS = {
    "QUAL > 30": "CAST(qual AS INT) > 30",
    "REF != 'A' and QUAL <= 40": "ref <> 'A' AND CAST(qual AS INT) <= 40",
    "DP % 2 == 0 or CHR == 'AF'": "CAST(qual AS INT) % 2 = 0 OR chrom = 'AF'",
    "not (QUAL > 10) and CHR in ('AF', 'RF')": "NOT CAST(qual AS INT) > 10 AND chrom IN ('AF', 'RF')",
    "10 < QUAL < 20": "CAST(qual AS INT) > 10 AND CAST(qual AS INT) < 20",
    "any('DP > 70')": "a1 + b1 > 70 OR (NOT gone AND a2 + b2 > 70)",
    "all('DP > 15')": "a1 + b1 > 15 AND (gone OR a2 + b2 > 15)",
    "atleast(2, 'DP * 2 >= 21') and POS - 1 > 2000": "a1 + b1 > 10 AND NOT gone AND a2 + b2 > 10 AND pos > 2001",
    'forsample(2, "DP > 8 and GT != \'0/1\'")': "NOT gone AND a2 + b2 > 8 AND g2 <> '0/1'",
    "crosscomp('DP[1] < DP[2]') or not any('NUM == 2')": "gone OR a1 + b1 < a2 + b2",
    "missing > 3 or FILTER == 'PASS'": "filter = 'PASS'",
}
_EXPRESSION_SQL = " UNION ALL ".join(f"SELECT {k} AS expression, count(*) AS n, sum(pos) AS places FROM calls WHERE {sql}" for k, sql in enumerate(EXPRESSIONS.values()))


@query("expression_filters", f"WITH {CALL_CTE} SELECT expression, n, CAST(places AS BIGINT) AS places FROM ({_EXPRESSION_SQL}) WHERE n > 0")
def expression_filters(spark, d):
    """Which calls each expression keeps, by their number and the sum of their positions."""
    met = F.array(*(F.when(expressions.condition(x), F.lit(k)) for k, x in enumerate(EXPRESSIONS)))
    rows = _parsed(spark, d).select("pos", F.explode(F.array_compact(met)).alias("expression"))
    return rows.groupBy("expression").agg(F.count("*").alias("n"), F.sum("pos").alias("places"))


@query("field_projection", f"WITH {CALL_CTE} SELECT chrom, pos, CASE WHEN NOT gone THEN a2 + b2 END AS dp FROM calls")
def field_projection(spark, d):
    return _parsed(spark, d).select("chrom", "pos", variants.field_of(2, "DP", "int").alias("dp"))


@query("filtered_count", f"WITH {CALL_CTE} SELECT count(*) AS n FROM calls WHERE CAST(qual AS INT) > 25")
def filtered_count(spark, d):
    return variants.filtered(_parsed(spark, d), "qual > 25", count=True)


_A, _B = "CAST(qual AS INT) > 25", "l_linenumber % 2 = 0"


def _sides(spark, d):
    rows = _parsed(spark, d)
    return rows.filter("qual > 25"), rows.filter("array_contains(filter, 'PASS')")


def _set_sql(word: str) -> str:
    one = "SELECT chrom || '@' || CAST(pos AS VARCHAR) AS key FROM calls WHERE "
    return f"WITH {CALL_CTE} {one} CAST(qual AS INT) > 25 {word} {one} filter = 'PASS'"


@query("coords_intersect", _set_sql("INTERSECT"))
def coords_intersect(spark, d):
    return variants.intersect(*_sides(spark, d))


@query("coords_union", _set_sql("UNION"))
def coords_union(spark, d):
    return variants.union(*_sides(spark, d))


@query("coords_except", _set_sql("EXCEPT"))
def coords_except(spark, d):
    return variants.subtract(*_sides(spark, d))


@query("coords_semi", f"WITH {CALL_CTE} SELECT chrom, pos, ref, qual FROM calls WHERE (chrom, pos) IN (SELECT chrom, pos FROM calls WHERE CAST(qual AS INT) = 50) AND CAST(qual AS INT) < 10".replace("ref, qual", "ref, CAST(qual AS DOUBLE) AS qual"))
def coords_semi(spark, d):
    rows = _parsed(spark, d)
    return variants.select_keys(rows.filter("qual < 10"), rows.filter("qual = 50")).select("chrom", "pos", "ref", "qual")


@query("split_key", f"WITH {CALL_CTE} SELECT DISTINCT chrom, pos FROM calls")
def split_key(spark, d):
    chrom, pos = variants.split_key(F.col("key"))
    return _parsed(spark, d).select(chrom.alias("chrom"), pos.alias("pos")).distinct()


@query("last_per_key", f"WITH {D.SNP_CTE} SELECT chrom, pos, max(vid) AS vid FROM snps GROUP BY chrom, pos")
def last_per_key(spark, d):
    rows = D.snps(spark, d).withColumn("key", F.concat_ws("@", "chrom", "pos")).select("key", "chrom", "pos", "vid")
    return variants.last_per_key(rows, "vid").select("chrom", "pos", "vid")


@query("natural_order", f"WITH {D.SNP_CTE} SELECT chrom, pos, vid FROM snps ORDER BY chrom, pos, vid")
def natural_order(spark, d):
    return variants.natural_order(D.snps(spark, d).select("chrom", "pos", "vid"), "vid")


# ---- annotation

KIND = "vk AS (SELECT *, CASE WHEN length(ref) > 1 THEN 'D' WHEN length(alt) > 1 THEN 'I' ELSE 'S' END AS vartype, CASE WHEN length(ref) > 1 THEN length(ref) - 1 WHEN length(alt) > 1 THEN length(alt) - 1 ELSE 1 END AS len, CASE WHEN length(ref) > 1 THEN substr(ref, 2) WHEN length(alt) > 1 THEN substr(alt, 2) END AS seq FROM variants)"


@query("variant_kind", f"WITH {D.VARIANT_CTE}, {KIND} SELECT vid, vartype, CAST(len AS INT) AS len, seq FROM vk")
def variant_kind(spark, d):
    return consequence.variant_kind(D.variants(spark, d)).select("vid", "vartype", "len", "seq")


@query("peak_distance", f"WITH {D.VARIANT_CTE} SELECT vid, abs(pos - 5000000) AS distance FROM variants ORDER BY distance, vid")
def peak_distance(spark, d):
    return D.variants(spark, d).select("vid", consequence.peak_distance(5_000_000).alias("distance")).orderBy("distance", "vid")


@query("multi_alt_explode", f"WITH {CALL_CTE} SELECT chrom, pos, ref, unnest(string_split(alt, ',')) AS alt FROM calls")
def multi_alt_explode(spark, d):
    return consequence.explode_alternatives(D.project(D.table(spark, d, "lineitem"), CALLS).select("chrom", "pos", "ref", "alt"))


@query("annotate_flags", f"WITH {D.VARIANT_CTE} SELECT vid FROM variants WHERE NOT contains(filter, 'Cluster')")
def annotate_flags(spark, d):
    return D.variants(spark, d).filter(consequence.without_flags(["Clus.er"])).select("vid")


def _hits(spark, d):
    genes = D.genes(spark, d).withColumnRenamed("g_start", "f_start").withColumnRenamed("g_end", "f_end")
    kinds = consequence.variant_kind(D.variants(spark, d)).select("vid", "chrom", "pos", "alt", "vartype", "len", "seq")
    return overlap.features_of(kinds, genes.select("chrom", "gene", "strand", "f_start", "f_end"))


@query(
    "feature_overlap",
    f"WITH {D.VARIANT_CTE}, {KIND}, {D.GENE_CTE} SELECT vid, gene, CASE WHEN gene IS NOT NULL THEN greatest(pos, g_start) END AS hit_start, CASE WHEN gene IS NOT NULL THEN least(CASE WHEN vartype = 'D' THEN pos + len - 1 ELSE pos END, g_end) END AS hit_end "
    "FROM vk LEFT JOIN genes ON vk.chrom = genes.chrom AND pos <= g_end AND CASE WHEN vartype = 'D' THEN pos + len - 1 ELSE pos END >= g_start AND (vartype <> 'I' OR pos < g_end)",
)
def feature_overlap(spark, d):
    return _hits(spark, d).select("vid", "gene", "hit_start", "hit_end")


@query(
    "gene_positions",
    f"WITH {D.VARIANT_CTE}, {KIND}, {D.GENE_CTE}, h AS (SELECT *, CASE WHEN vartype = 'D' THEN pos + len - 1 ELSE pos END AS e FROM vk JOIN genes ON vk.chrom = genes.chrom AND pos <= g_end AND CASE WHEN vartype = 'D' THEN pos + len - 1 ELSE pos END >= g_start AND (vartype <> 'I' OR pos < g_end)) "
    "SELECT vid, gene, CASE WHEN strand = '+' THEN pos - g_start + 1 WHEN vartype = 'S' THEN g_end - pos + 1 WHEN vartype = 'I' THEN g_end - pos ELSE g_end - least(e, g_end) + 1 END AS gene_pos FROM h",
)
def gene_positions(spark, d):
    rows = _hits(spark, d).filter("gene IS NOT NULL").withColumnRenamed("f_start", "g_start").withColumnRenamed("f_end", "g_end")
    return rows.select("vid", "gene", consequence.gene_position().alias("gene_pos"))


OFFSETS = "ex AS (SELECT *, e_end - e_start + 1 AS size, coalesce(CAST(sum(e_end - e_start + 1) OVER (PARTITION BY gene ORDER BY e_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS exon_off, CAST(sum(e_end - e_start + 1) OVER (PARTITION BY gene) AS BIGINT) AS cds_len, lag(e_end) OVER (PARTITION BY gene ORDER BY e_start) AS prev_end, lead(e_start) OVER (PARTITION BY gene ORDER BY e_start) AS next_start FROM exons)"


@query("exon_offsets", f"WITH {D.EXON_CTE}, {OFFSETS} SELECT gene, e_start, exon_off, cds_len, prev_end, next_start FROM ex")
def exon_offsets(spark, d):
    return consequence.exon_offsets(D.exons(spark, d)).select("gene", "e_start", "exon_off", "cds_len", "prev_end", "next_start")


@query(
    "coding_sequence",
    f"WITH {D.EXON_CTE}, q AS (SELECT gene, e_start, substr({D.DNA}, CAST(e_start - g_start + 1 AS INT), CAST(e_end - e_start + 1 AS INT)) AS seq FROM exons) SELECT gene, md5(string_agg(seq, '' ORDER BY e_start)) AS cds, CAST(length(string_agg(seq, '' ORDER BY e_start)) AS INT) AS n FROM q GROUP BY gene",
)
def coding_sequence(spark, d):
    parts = D.exons(spark, d).withColumn("seq", F.substr(F.expr(D.DNA), (F.col("e_start") - F.col("g_start") + 1).cast("int"), (F.col("e_end") - F.col("e_start") + 1).cast("int")))
    return consequence.coding_sequence(parts).select("gene", F.md5("cds").alias("cds"), F.length("cds").alias("n"))


CODE = S.AMINO_ACIDS


def _aa(codon: str) -> str:
    place = [f"instr('TCAG', substr({codon}, {i}, 1))" for i in (1, 2, 3)]
    return f"CASE WHEN length({codon}) = 3 AND {place[0]} > 0 AND {place[1]} > 0 AND {place[2]} > 0 THEN substr('{CODE}', CAST(16 * {place[0]} + 4 * {place[1]} + {place[2]} - 20 AS INT), 1) ELSE 'X' END"


def _coding(spark, d, kind: str):
    """Variants of a kind inside exons, with the coding sequence of their gene."""
    ex = consequence.exon_offsets(D.exons(spark, d)).withColumn("cds_len", F.col("cds_len").cast("int"))
    features = ex.withColumn("f_start", F.col("e_start")).withColumn("f_end", F.col("e_end"))
    kinds = consequence.variant_kind(D.variants(spark, d)).filter(F.col("vartype") == kind).select("vid", "chrom", "pos", "alt", "vartype", "len", "seq")
    rows = overlap.features_of(kinds, features).filter("gene IS NOT NULL")
    return rows.withColumn("cds", F.substr(F.expr(D.DNA), F.lit(1), F.col("cds_len")))


CODING_SNPS = (
    f"WITH {D.VARIANT_CTE}, {KIND}, {D.EXON_CTE}, {OFFSETS}, h AS (SELECT vid, gene, strand, alt, CAST(exon_off + pos - e_start + 1 AS INT) AS cp, CAST(cds_len AS INT) AS n, {D.DNA} AS dna FROM vk JOIN ex ON vk.chrom = ex.chrom AND vartype = 'S' AND pos BETWEEN e_start AND e_end), "
    "c AS (SELECT *, substr(substr(dna, 1, n), ((cp - 1) // 3) * 3 + 1, 3) AS raw FROM h), "
    "t AS (SELECT *, CASE WHEN strand = '+' THEN raw ELSE translate(reverse(raw), 'ACGT', 'TGCA') END AS codon, CASE WHEN strand = '+' THEN (cp - 1) % 3 + 1 ELSE (n - cp) % 3 + 1 END AS cpos, CASE WHEN strand = '+' THEN alt ELSE translate(alt, 'ACGT', 'TGCA') END AS base FROM c), "
    "u AS (SELECT *, substr(codon, 1, cpos - 1) || base || substr(codon, cpos + 1) AS codon_alt FROM t), "
    f"w AS (SELECT *, CASE WHEN length(codon) < 3 THEN 'NNN' ELSE {_aa('codon')} END AS ref_aa, {_aa('codon_alt')} AS new_aa FROM u) "
)


@query(
    "snp_consequence",
    CODING_SNPS
    + "SELECT vid, gene, cp AS cds_pos, CAST(cpos AS INT) AS codon_pos, ref_aa, new_aa, CASE WHEN ref_aa = new_aa THEN 'Syn' ELSE 'Nonsyn' END AS kind, ref_aa <> new_aa AND new_aa = '*' AS new_stop, ref_aa <> new_aa AND ref_aa = '*' AS lost_stop, ref_aa <> new_aa AND new_aa <> 'M' AND CASE WHEN strand = '+' THEN cp <= 3 ELSE cp >= n - 2 END AS lost_start FROM w",
)
def snp_consequence(spark, d):
    rows = _coding(spark, d, "S").withColumn("cds_pos", consequence.cds_position())
    return consequence.snp_consequence(rows).select("vid", "gene", "cds_pos", "codon_pos", "ref_aa", "new_aa", "kind", "new_stop", "lost_stop", "lost_start")


@query("effect_label", CODING_SNPS + "SELECT CASE WHEN ref_aa <> new_aa AND new_aa = '*' THEN 'nonsense' WHEN ref_aa <> new_aa AND ((new_aa <> 'M' AND CASE WHEN strand = '+' THEN cp <= 3 ELSE cp >= n - 2 END) OR ref_aa = '*') THEN 'start/stop lost' WHEN ref_aa <> new_aa THEN 'missense' ELSE 'synonymous' END AS label, count(*) AS n FROM w GROUP BY 1")
def effect_label(spark, d):
    rows = consequence.snp_consequence(_coding(spark, d, "S").withColumn("cds_pos", consequence.cds_position()))
    return rows.groupBy(consequence.effect_label().alias("label")).agg(F.count("*").alias("n"))


CODING_INS = f"WITH {D.VARIANT_CTE}, {KIND}, {D.EXON_CTE}, {OFFSETS}, h AS (SELECT vid, gene, strand, seq, pos, e_end, CAST(exon_off + pos - e_start + 1 AS INT) AS cp, CAST(cds_len AS INT) AS n, {D.DNA} AS dna FROM vk JOIN ex ON vk.chrom = ex.chrom AND vartype = 'I' AND pos >= e_start AND pos < e_end), a AS (SELECT *, substr(dna, 1, cp) || seq || substr(substr(dna, 1, n), cp + 1) AS alt_cds FROM h) "


@query(
    "ins_effects",
    CODING_INS + "SELECT vid, gene, cp AS cds_pos, md5(alt_cds) AS alt_cds, length(seq) % 3 <> 0 AS frameshift, pos = e_end AND cp <> n AS splicechange, CASE WHEN strand = '+' THEN cp < 3 ELSE cp <> n AND cp > n - 3 END AS lost_start FROM a",
)
def ins_effects(spark, d):
    rows = consequence.insertion_effects(_coding(spark, d, "I").withColumn("cds_pos", consequence.cds_position()))
    return rows.select("vid", "gene", "cds_pos", F.md5("alt_cds").alias("alt_cds"), "frameshift", "splicechange", "lost_start")


def _stop_sql(cds: str, at: str) -> str:
    part = f"substr({cds}, CAST((greatest({at}, 1) - 1) // 3 * 3 + 1 AS INT))"
    return f"coalesce(list_position(list_transform(range(0, length({part}) // 3), lambda i: substr({part}, CAST(3 * i + 1 AS INT), 3) IN ('TAA', 'TAG', 'TGA')), true), 0)"


@query("new_stop_scan", CODING_INS + f", s AS (SELECT vid, gene, CASE WHEN strand = '+' THEN alt_cds ELSE translate(reverse(alt_cds), 'ACGT', 'TGCA') END AS c, CASE WHEN strand = '+' THEN cp ELSE n - cp END AS spot FROM a) SELECT vid, gene, CAST({_stop_sql('c', 'spot')} AS INT) AS new_stop FROM s")
def new_stop_scan(spark, d):
    rows = consequence.insertion_effects(_coding(spark, d, "I").withColumn("cds_pos", consequence.cds_position()))
    return rows.select("vid", "gene", "new_stop")


DEL_SPANS = f"WITH {D.VARIANT_CTE}, {KIND}, {D.EXON_CTE}, {OFFSETS}, h AS (SELECT vid, gene, strand, {D.DNA} AS dna, CAST(cds_len AS INT) AS n, exon_off + greatest(pos, e_start) - e_start + 1 AS l, exon_off + least(pos + len - 1, e_end) - e_start + 1 AS r, (pos + len - 1 > e_end AND next_start IS NOT NULL) OR (pos < e_start AND prev_end IS NOT NULL) AS o FROM vk JOIN ex ON vk.chrom = ex.chrom AND vartype = 'D' AND pos <= e_end AND pos + len - 1 >= e_start), g AS (SELECT vid, gene, CAST(min(l) AS INT) AS l, CAST(max(r) AS INT) AS r, bool_or(o) AS splicechange, any_value(strand) AS strand, any_value(dna) AS dna, any_value(n) AS n FROM h GROUP BY vid, gene) "


@query(
    "del_effects",
    DEL_SPANS + "SELECT vid, gene, l AS cds_left, r AS cds_right, splicechange, (r - l + 1) % 3 <> 0 AS frameshift, CASE WHEN strand = '+' THEN l < 4 ELSE r >= n - 3 END AS lost_start, md5(substr(dna, 1, l - 1) || substr(substr(dna, 1, n), r + 1)) AS alt_cds FROM g",
)
def del_effects(spark, d):
    hits = _coding(spark, d, "D").withColumn("start", F.col("pos")).withColumn("end", F.col("pos") + F.col("len") - 1)
    spans = consequence.deletion_spans(hits)
    # Coding sequences are made behind the join; in it they would be a copy for each deletion.
    genes = hits.select("vid", "gene", "strand", "cds_len").distinct()
    rows = spans.join(genes, ["vid", "gene"]).withColumn("cds", F.substr(F.expr(D.DNA), F.lit(1), F.col("cds_len")))
    rows = consequence.deletion_effects(rows)
    return rows.select("vid", "gene", "cds_left", "cds_right", "splicechange", "frameshift", "lost_start", F.md5("alt_cds").alias("alt_cds"))


@query(
    "region_string",
    f"WITH {D.VARIANT_CTE}, {KIND}, {D.EXON_CTE}, h AS (SELECT vid, gene, greatest(pos, e_start) AS s, least(pos + len * 400 - 1, e_end) AS e FROM vk JOIN exons ON vk.chrom = exons.chrom AND vartype = 'D' AND pos <= e_end AND pos + len * 400 - 1 >= e_start), "
    "p AS (SELECT *, s - lag(e) OVER (PARTITION BY vid, gene ORDER BY s) - 1 AS gap FROM h) SELECT vid, gene, string_agg(CASE WHEN gap > 0 THEN concat('intronic/noncoding,', gap, '-') ELSE '' END || concat('CDS,', e - s + 1), '-' ORDER BY s) AS regions FROM p GROUP BY vid, gene",
)
def region_string(spark, d):
    kinds = consequence.variant_kind(D.variants(spark, d)).filter("vartype = 'D'").withColumn("len", F.col("len") * 400).select("vid", "chrom", "pos", "vartype", "len")
    hits = overlap.features_of(kinds, D.exons(spark, d).withColumn("f_start", F.col("e_start")).withColumn("f_end", F.col("e_end"))).filter("gene IS NOT NULL")
    return consequence.region_string(hits.withColumn("type", F.lit("CDS")))


@query(
    "splice_sites",
    f"WITH {D.VARIANT_CTE}, {KIND}, {D.EXON_CTE}, {OFFSETS} SELECT vid, gene, pos <= e_end + 1 + CAST(vartype = 'S' AS INT) OR pos >= next_start - 2 AS splice FROM vk JOIN ex ON vk.chrom = ex.chrom AND vartype <> 'D' AND next_start IS NOT NULL AND pos > e_end AND pos < next_start",
)
def splice_sites(spark, d):
    introns = consequence.exon_offsets(D.exons(spark, d)).filter("next_start IS NOT NULL")
    right = introns.select("chrom", "gene", F.col("e_end").alias("prev_end"), "next_start", (F.col("e_end") + 1).alias("r_start"), (F.col("next_start") - 1).alias("r_end"))
    kinds = consequence.variant_kind(D.variants(spark, d)).filter("vartype <> 'D'")
    met = overlap.overlap_join(overlap.variant_interval(kinds), right)
    return met.select("vid", "gene", consequence.splice_site().alias("splice"))


@query("sample_label", f"WITH {CALL_CTE} SELECT chrom, pos, alt, CASE WHEN contains(alt, ',') THEN 'na' ELSE (CASE WHEN contains(ref, alt) THEN ref ELSE '' END) || '>' || alt END AS label FROM calls")
def sample_label(spark, d):
    rows = D.project(D.table(spark, d, "lineitem"), CALLS).withColumn("major", F.col("ref")).withColumn("minor", F.col("alt"))
    return rows.select("chrom", "pos", "alt", consequence.sample_label().alias("label"))


_EDITED = (
    f"WITH RECURSIVE {D.EXON_CTE}, {OFFSETS}, gs AS (SELECT DISTINCT gene, strand, substr({D.DNA}, 1, CAST(cds_len AS INT)) AS cds FROM ex), "
    f"e AS (SELECT gene, cp AS l, cp AS r, 'S' AS k, alt AS seq FROM ({CODING_SNPS} SELECT gene, cp, alt FROM h) UNION ALL SELECT gene, cp, cp, 'I', seq FROM ({CODING_INS} SELECT gene, cp, seq FROM h) UNION ALL SELECT gene, l, r, 'D', NULL FROM ({DEL_SPANS} SELECT gene, l, r FROM g)), "
    "o AS MATERIALIZED (SELECT *, CASE WHEN k = 'I' THEN l ELSE l - 1 END AS upto, row_number() OVER (PARTITION BY gene ORDER BY l, r, k, seq) AS n FROM e), "
    "acc AS (SELECT gene, CAST(0 AS BIGINT) AS n, 0 AS at_end FROM gs UNION ALL SELECT gene, n, greatest(upto, r) FROM (SELECT o.*, row_number() OVER (PARTITION BY o.gene ORDER BY o.n) AS k1 FROM acc JOIN o ON o.gene = acc.gene AND o.n > acc.n AND o.upto >= acc.at_end) WHERE k1 = 1), "
    "pc AS (SELECT gene, n, at_end, lag(at_end) OVER (PARTITION BY gene ORDER BY n) AS before FROM acc), "
    "cut AS (SELECT pc.gene, pc.n, substr(cds, before + 1, upto - before) AS kept, CASE WHEN k = 'I' THEN repeat('-', length(seq)) ELSE substr(cds, l, r - l + 1) END AS gone, CASE WHEN k = 'D' THEN repeat('-', r - l + 1) ELSE seq END AS new FROM pc JOIN gs USING (gene) JOIN o ON o.gene = pc.gene AND o.n = pc.n), "
    "jn AS (SELECT gene, string_agg(kept || gone, '' ORDER BY n) AS ref, string_agg(kept || new, '' ORDER BY n) AS alt, count(*) AS edited FROM cut GROUP BY gene), tl AS (SELECT gene, max(at_end) AS at_end FROM acc GROUP BY gene), "
    "al AS (SELECT gene, coalesce(ref, '') || substr(cds, at_end + 1) AS ref, coalesce(alt, '') || substr(cds, at_end + 1) AS alt, strand, CAST(coalesce(edited, 0) AS INT) AS edited FROM gs JOIN tl USING (gene) LEFT JOIN jn USING (gene)), "
    "fin AS (SELECT gene, CASE WHEN strand = '+' THEN ref ELSE translate(reverse(ref), 'ACGT', 'TGCA') END AS ref, CASE WHEN strand = '+' THEN alt ELSE translate(reverse(alt), 'ACGT', 'TGCA') END AS alt, edited FROM al) "
)


def _aligned(spark, d):
    rows = _coding(spark, d, "S").withColumn("cds_left", consequence.cds_position())
    edits = rows.select("gene", "vartype", "cds_left", F.col("cds_left").alias("cds_right"), F.col("alt").alias("seq"))
    ins = _coding(spark, d, "I").withColumn("cds_left", consequence.cds_position()).select("gene", "vartype", "cds_left", F.col("cds_left").alias("cds_right"), "seq")
    hits = _coding(spark, d, "D").withColumn("start", F.col("pos")).withColumn("end", F.col("pos") + F.col("len") - 1)
    gone = consequence.deletion_spans(hits).select("gene", F.lit("D").alias("vartype"), "cds_left", "cds_right", F.lit(None).cast("string").alias("seq"))
    ex = consequence.exon_offsets(D.exons(spark, d)).select("gene", "strand", F.col("cds_len").cast("int").alias("cds_len")).distinct()
    genes = ex.select("gene", "strand", F.substr(F.expr(D.DNA), F.lit(1), F.col("cds_len")).alias("cds"))
    return consequence.gene_alignment(genes, edits.unionByName(ins).unionByName(gone))


@query("gene_alignment", _EDITED + "SELECT gene, ref, alt FROM fin")
def gene_alignment(spark, d):
    return _aligned(spark, d).select("gene", "ref", "alt")


@query("alignment_file", _EDITED + "SELECT concat_ws(chr(10), '>' || gene, ref, alt) AS lines FROM fin WHERE edited > 0")
def alignment_file(spark, d):
    """Genes with variants in their coding sequence, three lines each."""
    return _aligned(spark, d).filter("edited > 0").select(consequence.alignment_lines().alias("lines"))


@query("mut_output", CODING_SNPS + "SELECT concat_ws(chr(9), vid, gene, CASE WHEN ref_aa = new_aa THEN 'Syn' ELSE 'Nonsyn' END, ref_aa || '>' || new_aa) AS line FROM w")
def mut_output(spark, d):
    rows = consequence.snp_consequence(_coding(spark, d, "S").withColumn("cds_pos", consequence.cds_position()))
    return rows.select(tabbed("vid", "gene", "kind", F.concat("ref_aa", F.lit(">"), "new_aa")).alias("line"))


# ---- sequences

CLEAN = "q AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)"


def _dna(spark, d):
    return R.spread(D.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", S.clean_dna(F.col("text")).alias("seq"))


@query("revcomp", f"WITH {CLEAN} SELECT doc_id, md5(translate(reverse(seq), 'ACGT', 'TGCA')) AS rc FROM q")
def revcomp(spark, d):
    return _dna(spark, d).select("doc_id", F.md5(S.revcomp(F.col("seq"))).alias("rc"))


@query("revcomp_iupac")
def revcomp_iupac(spark, d):
    return D.table(spark, d, "documents").select("doc_id", F.md5(S.revcomp_iupac(F.col("text"))).alias("rc"))


@query("iupac", f"WITH {D.SNP_CTE} SELECT vid, qual, CASE WHEN ref || alt IN ('AT', 'TA') THEN 'W' WHEN ref || alt IN ('CG', 'GC') THEN 'S' WHEN ref || alt IN ('AC', 'CA') THEN 'M' WHEN ref || alt IN ('GT', 'TG') THEN 'K' WHEN ref || alt IN ('CT', 'TC') THEN 'Y' WHEN ref || alt IN ('AG', 'GA') THEN 'R' END AS letter FROM snps")
def iupac(spark, d):
    return D.snps(spark, d).select("vid", "qual", S.to_iupac(F.col("ref"), F.col("alt")).alias("letter"))


@query("translate_cds", f"WITH {CLEAN} SELECT doc_id, md5(coalesce(array_to_string(list_transform(range(0, length(seq) // 3), lambda i: {_aa('substr(seq, CAST(3 * i + 1 AS INT), 3)')}), ''), '')) AS protein FROM q")
def translate_cds(spark, d):
    return _dna(spark, d).select("doc_id", F.md5(S.translate_cds(F.col("seq"))).alias("protein"))


@query("subsequence", f"WITH {D.GENE_CTE} SELECT gene, substr({D.DNA}, 11, CAST(g_end - g_start AS INT)) AS seq FROM genes")
def subsequence(spark, d):
    genes = D.genes(spark, d)
    chunks = R.chunked(genes.select(F.col("gene").alias("chrom"), F.expr(D.DNA).alias("seq")), 1000)
    regions = genes.select("gene", F.col("gene").alias("chrom"), F.lit(11).cast("long").alias("start"), (10 + F.col("g_end") - F.col("g_start")).alias("end"))
    return R.subsequences(regions, chunks, 1000, "gene").select("gene", "seq")


@query("masked_length", "SELECT doc_id, CAST(length(text) - length(replace(text, 'n', '')) AS INT) AS n FROM documents")
def masked_length(spark, d):
    return D.table(spark, d, "documents").select("doc_id", S.masked_length(F.col("text"), "n").alias("n"))


# ---- primers and assays


def _roles(spark, d):
    rows = D.variants(spark, d).withColumn("flags", F.split("filter", ";"))
    return primers.roles(rows.withColumn("type", normalise.variant_type(F.col("ref"), F.split("alt", ","))), ["PASS"])


ROLES = "r AS (SELECT *, CASE WHEN filter = 'PASS' AND length(ref) = 1 AND length(alt) = 1 AND ref <> alt THEN 'primary' WHEN filter <> 'PASS' AND NOT (length(ref) >= 5 OR length(alt) >= 5) THEN 'secondary' END AS role FROM variants)"


@query("primary_secondary", f"WITH {D.VARIANT_CTE}, {ROLES} SELECT vid, role FROM r WHERE role IS NOT NULL")
def primary_secondary(spark, d):
    return _roles(spark, d).select("vid", "role")


def _neighbours(spark, d):
    rows = _roles(spark, d)
    others = rows.filter("role = 'secondary'").select(F.col("vid").alias("o_id"), "chrom", F.col("pos").alias("o_pos"), F.col("ref").alias("o_ref"), F.col("alt").alias("o_alt"))
    return rows.filter("role = 'primary'"), others


@query("secondary_neighbours", f"WITH {D.VARIANT_CTE}, {ROLES} SELECT a.vid, b.vid AS o_id FROM r a JOIN r b ON a.role = 'primary' AND b.role = 'secondary' AND a.chrom = b.chrom AND abs(a.pos - b.pos) <= 1000 AND a.vid <> b.vid")
def secondary_neighbours(spark, d):
    primary, others = _neighbours(spark, d)
    return overlap.neighbours(primary.select("vid", "chrom", "pos"), others, 1000).select("vid", "o_id")


GENOME = "repeat(translate(md5(chrom), '0123456789abcdef', 'ACGTACGTACGTACGT'), 62510)"


@query(
    "template_mask",
    f"WITH {D.VARIANT_CTE}, {ROLES}, s AS (SELECT *, pos % 2000000 + 1 AS p FROM r WHERE role IS NOT NULL), a AS (SELECT *, substr({GENOME.replace('62510', '4')}, CAST((p - 31) % 32 + 1 AS INT), 61) AS g FROM s WHERE role = 'primary' AND p > 30), "
    "m AS (SELECT a.vid, unnest(CASE WHEN length(b.ref) > 1 THEN range(b.p - a.p + 30, b.p - a.p + 30 + length(b.ref)) WHEN length(b.alt) > 1 THEN [b.p - a.p + 31] ELSE [b.p - a.p + 30] END) AS i FROM a JOIN s b ON b.role = 'secondary' AND a.chrom = b.chrom AND abs(a.p - b.p) <= 30 AND a.vid <> b.vid), "
    "k AS (SELECT vid, list(DISTINCT i) AS w FROM m GROUP BY vid) "
    "SELECT a.vid, array_to_string(list_transform(range(0, 61), lambda j: CASE WHEN j = 30 THEN CASE WHEN ref || alt IN ('AT', 'TA') THEN 'W' WHEN ref || alt IN ('CG', 'GC') THEN 'S' WHEN ref || alt IN ('AC', 'CA') THEN 'M' WHEN ref || alt IN ('GT', 'TG') THEN 'K' WHEN ref || alt IN ('CT', 'TC') THEN 'Y' ELSE 'R' END WHEN list_contains(coalesce(w, []), j) THEN 'N' ELSE substr(g, CAST(j + 1 AS INT), 1) END), '') AS template FROM a LEFT JOIN k USING (vid)",
)
def template_mask(spark, d):
    primary, others = _neighbours(spark, d)
    primary = primary.withColumn("pos", F.col("pos") % 2_000_000 + 1).withColumn("major", F.col("ref"))
    others = others.withColumn("o_pos", F.col("o_pos") % 2_000_000 + 1)
    chroms = primary.select("chrom").distinct().withColumn("seq", F.expr(GENOME))
    return primers.templates(primary, others, R.chunked(chroms, 4000), 4000, 30).select("vid", "template")


PRODUCT = f"WITH {D.GENE_CTE}, t AS (SELECT gene, strand, substr({D.DNA}, 1, 101) AS t, CAST(gene % 20 AS INT) AS l, CAST(60 + gene % 40 AS INT) AS r FROM genes), p AS (SELECT *, substr(t, l + 1, r - l + 1) || 'GAATTC' AS raw FROM t) "


@query("product_extract", PRODUCT + "SELECT gene, CASE WHEN strand = '+' THEN raw ELSE translate(reverse(raw), 'ACGT', 'TGCA') END AS product_seq, CAST(length(raw) AS INT) AS product_len, CAST(CASE WHEN strand = '+' THEN 50 - l + 1 ELSE r - 50 + 1 + 6 END AS INT) AS snp_place, 0 AS n_count FROM p")
def product_extract(spark, d):
    rows = D.genes(spark, d).select("gene", F.when(F.col("strand") == "+", "fwd").otherwise("rev").alias("direction"), F.substr(F.expr(D.DNA), F.lit(1), F.lit(101)).alias("template"), (F.col("gene") % 20).cast("int").alias("left_start"), (60 + F.col("gene") % 40).cast("int").alias("right_start"))
    return rows.select("gene", *primers.product(50, "GAATTC"))


@query("primer_request", f"WITH {D.GENE_CTE} SELECT gene, concat_ws(chr(10), 'SEQUENCE_ID=' || CAST(gene AS VARCHAR), 'SEQUENCE_TEMPLATE=' || substr({D.DNA}, 1, 801), 'SEQUENCE_PRIMER_PAIR_OK_REGION_LIST=350,47,630,120', 'PRIMER_PRODUCT_SIZE_RANGE=280-400', 'PRIMER_NUM_RETURN=1', '=') AS request FROM genes")
def primer_request(spark, d):
    rows = D.genes(spark, d).select("gene", F.col("gene").alias("vid"), F.substr(F.expr(D.DNA), F.lit(1), F.lit(801)).alias("template"))
    return rows.select("gene", primers.request(primers.Layout()).alias("request"))


@query(
    "primer_matches",
    f"WITH {D.GENE_CTE}, c AS MATERIALIZED (SELECT gene, {D.DNA} AS s FROM genes), pr AS (SELECT DISTINCT substr(s, CAST(1 + gene % 13 AS INT), 12) AS primer FROM c), "
    "asked AS MATERIALIZED (SELECT primer AS word FROM pr UNION SELECT translate(reverse(primer), 'ACGT', 'TGCA') FROM pr), "
    "k AS MATERIALIZED (SELECT substr(s, CAST(1 + 100 * j AS INT), 111) AS piece FROM (SELECT s, unnest(range(0, (length(s) + 99) // 100)) AS j FROM c)), "
    "w AS (SELECT unnest(list_transform(range(1, length(piece) - 10), lambda i: substr(piece, i, 12))) AS word FROM k), "
    "n AS MATERIALIZED (SELECT word, count(*) AS n FROM w WHERE word IN (SELECT word FROM asked) GROUP BY word) "
    "SELECT primer, CAST(coalesce(a.n, 0) + CASE WHEN translate(reverse(primer), 'ACGT', 'TGCA') = primer THEN 0 ELSE coalesce(b.n, 0) END AS BIGINT) AS hits FROM pr LEFT JOIN n a ON a.word = primer LEFT JOIN n b ON b.word = translate(reverse(primer), 'ACGT', 'TGCA')",
)
def primer_matches(spark, d):
    genes = R.spread(D.genes(spark, d)).select("gene", F.expr(D.DNA).alias("seq"))
    wanted = genes.select(F.substr("seq", (1 + F.col("gene") % 13).cast("int"), F.lit(12)).alias("primer"))
    starts = F.explode(F.sequence(F.lit(1), F.length("seq"), F.lit(100))).alias("at")
    chunks = genes.select("seq", starts).select(F.substr("seq", F.col("at"), F.lit(100 + 12 - 1)).alias("chunk_seq"))
    return primers.matches(wanted, chunks, 12)


@query(
    "shore_barcodes",
    "WITH b AS (SELECT n_name AS sample, upper(substr(md5(n_name), 1, 6)) AS code FROM nation), a AS (SELECT p_partkey AS id, substr(md5(p_name), 1, 10) AS l, substr(md5(p_name), 11, 10) AS r FROM part), "
    "x AS (SELECT id, sample, code, l, r, unnest([1, 2, 3, 4, 5, 6]) AS k FROM a, b) SELECT CAST(CASE WHEN k IN (1, 4) THEN 1 WHEN k IN (2, 5) THEN 3 ELSE 2 END AS INT) AS kind, CASE WHEN k IN (3, 6) THEN code ELSE '*' END AS code, CASE WHEN k IN (1, 5) THEN l WHEN k IN (2, 4) THEN r ELSE '*' END AS primer, '5prime' AS place, CAST(CASE WHEN k <= 3 THEN 1 ELSE 2 END AS INT) AS grp, concat(sample, '_', id) AS name FROM x",
)
def shore_barcodes(spark, d):
    codes = D.table(spark, d, "nation").select(F.col("n_name").alias("sample"), F.upper(F.substr(F.md5("n_name"), F.lit(1), F.lit(6))).alias("code"))
    rows = D.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.substr(F.md5("p_name"), F.lit(1), F.lit(10)).alias("primer_left"), F.substr(F.md5("p_name"), F.lit(11), F.lit(10)).alias("primer_right"))
    return assays.barcode_rows(rows, codes)


@query("assay_vcf", f"WITH {D.VARIANT_CTE} SELECT concat_ws(chr(9), chrom, pos, vid, ref, alt, '.', filter, '.') AS line FROM variants")
def assay_vcf(spark, d):
    from segspark.sources.sinks import assay_vcf_line

    return D.variants(spark, d).withColumnRenamed("vid", "id").select(assay_vcf_line().alias("line"))


@query("chromosome_names", f"WITH {D.SNP_CTE} SELECT 'chr' || chrom AS chrom, count(*) AS n FROM snps GROUP BY 1")
def chromosome_names(spark, d):
    rows = D.snps(spark, d).groupBy("chrom").agg(F.count("*").alias("n"))
    return R.translate_chromosomes(rows, rows.select("chrom", F.concat(F.lit("chr"), "chrom").alias("name")))


from segspark.plans import annotation_queries  # noqa: E402, F401
