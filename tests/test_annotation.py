"""Annotation from end to end on a hand-made gene, and designs against brute force."""

import hashlib
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from segspark.operators import annotate as A
from segspark.operators import consequence, primers, quality, sweep
from segspark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
VARIANTS = [
    ("v5", 5, "A", "G"), ("v12", 12, "T", "C"), ("v15", 15, "C", "T"), ("v16", 16, "T", "C"), ("v17", 17, "A", "T"), ("v20", 20, "G", "A"), ("v25", 25, "C", "A"),
    ("v28", 28, "A", "G"), ("v33", 33, "T", "C"), ("v13i", 13, "G", "GAA"), ("v14d", 14, "GCT", "G"), ("v18d", 18, "A" + "G" * 14, "A"), ("none", 900, "A", "C"),
]


def annotated(spark, strand="+", whole=False):
    rows = spark.createDataFrame([(v, "1", p, r, a) for v, p, r, a in VARIANTS], "vid string, chrom string, pos long, ref string, alt string")
    kinds = consequence.variant_kind(rows).withColumn("len", F.col("len").cast("int"))
    genes = spark.createDataFrame([("g1", "1", strand, 11, 40)], "gene string, chrom string, strand string, g_start long, g_end long")
    exons = spark.createDataFrame([("g1", "1", strand, 11, 19), ("g1", "1", strand, 30, 35)], "gene string, chrom string, strand string, e_start long, e_end long")
    cds = spark.createDataFrame([("g1", "ATGGCTAAACGTTAA")], "gene string, cds string")
    sequences = spark.createDataFrame([("g1", "ATGGCTAAAGTCCCCCCAGTCGTTAAGGGG")], "gene string, seq string")
    return A.annotate(kinds, genes, consequence.exon_offsets(exons), cds, sequences=sequences if whole else None)


def test_lines_of_a_hand_made_gene(spark):
    got = {r["vid"]: r["line"] for r in annotated(spark).select("vid", A.annotated_line(F.lit("s")).alias("line")).collect()}
    gene = lambda n: f"g1\t1\t11\t40\t+\t{n}"
    assert got["v5"] == "1\t5\ts\tA\tG\tintergenic" and got["none"] == "1\t900\ts\tA\tC\tintergenic"
    assert got["v15"] == f"1\t15\ts\tC\tT\tCDS\t{gene(5)}\t15\t5\t2\tNonsyn\tA\tV\tgCt\t0"
    assert got["v16"] == f"1\t16\ts\tT\tC\tCDS\t{gene(6)}\t15\t6\t3\tSyn\tA\tA\tgcT\t4"
    assert got["v12"].endswith("lost_start") and got["v17"].endswith("\tnew_stop (1)") and got["v33"].endswith("lost_stop")
    assert got["v20"] == f"1\t20\ts\tG\tA\tsplicesite\t{gene(10)}\tsplicechange" and got["v28"].endswith("splicechange")
    assert got["v25"] == f"1\t25\ts\tC\tA\tintronic/noncoding\t{gene(15)}"
    assert got["v13i"] == f"1\t13\ts\tG\tGAA\tCDS\t{gene(3)}\t15\t3\tlost_stop,frameshift"
    assert got["v14d"] == f"1\t14\ts\tGCT\tG\tCDS,2\t{gene(4)}\t15\t4\t5\t2\tnew_stop (1),frameshift"
    assert "CDS,2-intronic/noncoding,10-CDS,2" in got["v18d"] and "splicechange" in got["v18d"]


def test_splice_sites_show_their_bases(spark):
    of = lambda strand: {r["vid"]: r["line"].split("\t")[12:] for r in annotated(spark, strand, True).select("vid", A.annotated_line(F.lit("s")).alias("line")).collect()}
    plus, minus = of("+"), of("-")
    assert plus["v20"] == ["1", "Gt", "splicechange"] and plus["v28"] == ["1", "Ag", "splicechange"] and plus["v25"] == []
    assert minus["v20"] == ["2", "aC", "splicechange"] and minus["v28"] == ["2", "cT", "splicechange"]


def sweep_brute(variants, genes):
    out = []
    for v, c, start, end in variants:
        hits = [g for g, d, a, b in genes if c == d and a <= b and start is not None and start <= b and end >= a]
        out += [(v, g) for g in hits] or [(v, None)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("target, size", [(25_000, 20_000), (3, 50), (1, 7)])
def test_sweep_against_all_pairs(spark, target, size):
    """Long features over many ranges, nested ones, a hot place, repeated rows, nulls."""
    dice = random.Random(target)
    genes = [(i, dice.choice("AB"), s := dice.randint(1, 3000), s + dice.choice([0, 3, 40, 900])) for i in range(60)] + [(60, "A", 1, 10**6), (61, "C", 5, 4)]
    variants = [(i, dice.choice("ABD"), s := dice.randint(1, 4000), s + dice.choice([0, 0, 0, 25, 700])) for i in range(150)]
    variants += [(200 + i, "A", 77, 77) for i in range(90)] + [(300, None, 5, 5), (301, "A", None, None), (302, "A", 10**7, 10**7)]
    left = spark.createDataFrame(variants, "vid long, chrom string, start long, end long")
    right = spark.createDataFrame(genes, "gene long, chrom string, r_start long, r_end long")

    def merge(a, b, find=sweep.pairs("left")):
        i, j = find(a, b)
        return pa.table([*sweep.take(a, ["vid"], i), *sweep.take(b, ["gene"], j)], names=["vid", "gene"])

    got = sweep.sweep_join(left, right, "gene", merge, "vid long, gene long", target, size).collect()
    assert sorted(map(tuple, got), key=repr) == sweep_brute(variants, genes)
    assert sweep.sweep_join(left.filter("false"), right, "gene", merge, "vid long, gene long").count() == 0


def test_mutation_lines(spark):
    got = {r["vid"]: r["line"].split("\t") for r in annotated(spark).select("vid", A.mut_line(F.lit("s")).alias("line")).collect()}
    assert got["v15"] == ["1", "15", "15", "s", "nonsynonymous", "C>T", "g1", "5", "5", "gCt>gTt", "A>V", "0"]
    assert got["v16"][4] == "synonymous" and got["v17"][4] == "premature_stop (1)" and got["v20"][4] == "splicechange"
    assert got["v13i"] == ["1", "13", "14", "s", "lost_stop", "+AA", "g1", "3", "3"]
    assert got["v14d"] == ["1", "14", "15", "s", "premature_stop (1)", "-CT", "g1", "4", "4-5"]
    assert len(A.MUT_HEADER.split("\t")) == 11 and got["v5"] == ["1", "5", "5", "s", "intergenic", "A>G"]


def test_places_on_the_other_strand(spark):
    rows = {r["vid"]: r for r in annotated(spark, "-").collect()}
    assert (rows["v15"]["gene_pos"], rows["v15"]["cds_from"], rows["v15"]["codon_pos"]) == (26, 11, 2)
    assert (rows["v14d"]["gene_pos"], rows["v14d"]["cds_from"], rows["v14d"]["cds_to"]) == (26, 11, 12)
    assert (rows["v13i"]["gene_pos"], rows["v13i"]["cds_from"]) == (27, 12)


def test_no_variants_and_counts(spark):
    assert annotated(spark).filter("false").count() == 0
    rows = spark.createDataFrame([("primary", "SNP"), ("primary", "SNP"), ("secondary", "indel"), ("secondary", None)], "role string, type string")
    got = sorted(map(tuple, A.counts_by_list(rows, "role").collect()), key=repr)
    assert got == [("primary", 2), ("secondary", 2), (None, 4)]


def test_flip_by_parents(spark):
    rows = spark.createDataFrame([("A", "G", 1, 2, "G", "A", 3, 4, "A", "G"), ("A", "G", 1, 2, "A", "G", 3, 4, "T", "C")], "res_a1 string, res_a2 string, res_n1 int, res_n2 int, sus_a1 string, sus_a2 string, sus_n1 int, sus_n2 int, tn1_a1 string, um_a1 string")
    a, b = quality.flip_by_parents(rows).collect()
    assert tuple(a)[:8] == ("A", "G", 1, 2, "A", "G", 4, 3) and tuple(b)[:8] == ("A", "G", 1, 2, "A", "G", 3, 4)


def turned(s):
    return s[::-1].translate(str.maketrans("ACGTRY", "TGCAYR"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_designs_against_brute_force(spark):
    genes = [r[0] for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()]
    bases = str.maketrans("0123456789abcdef", "ACGT" * 4)
    seqs = {g: "".join(hashlib.md5(f"{g}:{i}".encode()).hexdigest() for i in range(1, 27)).translate(bases) for g in genes}
    places = {}
    for s in seqs.values():
        for i in range(len(s) - 19):
            places[s[i : i + 20]] = places.get(s[i : i + 20], 0) + 1
    hits = lambda p: sum(places.get(x, 0) for x in {p, turned(p)})
    fine = lambda p: len(p) == 20 and set(p) <= set("ACGT") and 8 <= sum(c in "GC" for c in p) <= 12

    def design(seq, direction):
        t = seq[:400] + "R" + seq[401:801]
        t = t if direction == "fwd" else turned(t)
        a, b, c, d = primers.Layout().regions()
        left = next((i for i in range(a + b - 20, a - 1, -1) if fine(t[i : i + 20])), None)
        right = next((i for i in range(c, c + d - 19) if fine(t[i : i + 20])), None)
        if left is None or right is None:
            return None
        p, q = t[left : left + 20], turned(t[right : right + 20])
        return (direction, p, q, right + 20 - left) if hits(p) == 1 and hits(q) == 1 else None

    want = {g: found for g, s in seqs.items() if (found := design(s, "fwd") or design(s, "rev"))}
    got = {r["vid"]: (r["direction"], r["primer_left"], r["primer_right"], r["product_len"]) for r in QUERIES["primer_designs"](spark, SF).collect()}
    assert got == want and len(got) > 150


def test_sequences_are_never_broadcast(spark):
    genes = spark.range(10).selectExpr("id AS gene", "'a' AS chrom", "'+' AS strand", "id * 100 AS g_start", "id * 100 + 99 AS g_end")
    exons = genes.selectExpr("gene", "g_start AS e_start", "g_end AS e_end", "0L AS exon_off", "100L AS cds_len")
    long = genes.selectExpr("gene", "repeat(cast(gene AS string), 100000) AS seq")
    models = A.gene_models(genes, exons, long.withColumnRenamed("seq", "cds"), long)
    assert "Broadcast" not in models._jdf.queryExecution().executedPlan().toString()
    assert sum(len(r["cds"]) + len(r["seq"]) for r in models.collect()) == 2_000_000
