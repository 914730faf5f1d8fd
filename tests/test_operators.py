"""Hand-derived cases and properties of single operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segspark.functions import sequence as S
from segspark.functions import stats as T
from segspark.operators import assays, bins, consequence, expressions, mapping, normalise, overlap, primers, quality, variants
from segspark.sources import sinks
from segspark.sources import text as R

VCF = [
    "##fileformat=VCFv4.1",
    "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tres\tsus",
    "1\t100\t.\tA\tG\t500\tPASS\tDP=40\tGT:AD:DP:GQ:PL\t0/1:3,17:20:99:1,2,3\t1|1:12,8:20:99:4,5,6",
    "1\t200\t.\tA\tG,T\t50\tq10\tDP=40;SB=1\tGT:AD:DP:GQ:PL\t0/1:3,17,1:21:99:1,2,3\t./.",
]
DESIGN = normalise.Design("res", "sus")


def test_normalise_case(spark):
    rows = {r["pos"]: r for r in normalise.normalise(R.read_vcf(spark, VCF), DESIGN).collect()}
    r = rows[100]
    assert (r["type"], r["major"], r["minor"], r["hapsc"]) == ("SNP", "G", "A", None)
    assert (r["segr_major"], r["segr_minor"]) == (25, 15)
    assert r["filter"] == ["NoSBtag", "NonPhasingPoolHomozygous"]
    assert r["res"] == "0/1:17,3:20:99:3,2,1" and r["sus"] == "0|0:8,12:20:99:6,5,4"
    m = rows[200]
    assert (m["type"], m["major"], m["segr_major"], m["filter"], m["sus"]) == ("multi-allelic", None, None, ["q10"], "na:na:na:na:na")


def test_first_parser_keeps_likelihoods(spark):
    r = normalise.normalise(R.read_vcf(spark, VCF), normalise.Design("res", "sus", swap_likelihoods=False)).filter("pos = 100").first()
    assert r["res"].endswith(":1,2,3")


def test_missing_tag_is_an_error(spark):
    bad = [VCF[1], "1\t1\t.\tA\tG\t5\tPASS\tDP=4\tGT:AD\t0/1:1,2\t0/1:1,2"]
    with pytest.raises(Exception, match="FORMAT lacks"):
        normalise.check_calls(R.read_vcf(spark, bad), DESIGN).collect()
    with pytest.raises(ValueError):
        normalise.check_calls(R.read_vcf(spark, bad), normalise.Design("a", "b", ("c",)))


def test_pooled_round_trip(spark, tmp_path):
    rows = normalise.normalise(R.read_vcf(spark, VCF), DESIGN).select(sinks.pooled_line(["res", "sus"]).alias("line"))
    path = str(tmp_path / "pooled")
    sinks.write_lines(rows, path, sinks.pooled_header(["res", "sus"]))
    text = sinks.pooled_header(["res", "sus"]) + [r[0] for r in spark.read.text(path).collect()]
    back = R.read_pooled(spark, text, "res", "sus").collect()
    assert [(r["chrom"], r["pos"], r["res_major"], r["res_minor"], r["sus_major"], r["geno_sus"]) for r in back] == [("1", 100, 17, 3, 8, "0|0")]
    with pytest.raises(Exception, match="exists"):
        sinks.write_lines(rows, path)
    sinks.write_lines(rows, path, force=True)


def test_score_files(spark, tmp_path):
    scores = spark.createDataFrame([("1", 5, 1.5)], "chrom string, pos long, score double")
    sinks.write_scores(scores, str(tmp_path / "s"))
    assert [tuple(r)[:3] for r in spark.read.csv(str(tmp_path / "s")).collect()] == [("1", "5", "1.5")]


def test_older_call_table(spark):
    line = "Gchr07\t5\t.\tA\tG\t9.5\tPASS\tGT:AD\t0/1:3,4\t1/1:0,9"
    r = R.read_two_sample_calls(spark, [line]).first()
    assert (r["chrom"], r["res_minor"], r["sus_minor"], r["geno_sus"], r["flags"]) == ("07", 4, 9, "1/1", ["PASS"])


def test_old_allele_table(spark):
    r = R.read_allele_table(spark, ["head " * 3, "1 7 A N 5 6 A N 7 8 x x x x A N 9 0 C N 11 0"]).first()
    assert (r["sus_n2"], r["res_n1"], r["um_n1"], r["tn1_a1"], r["tn1_n1"]) == (6, 7, 9, "C", 11)


GENE = "ATGGCTAAACGTTAA"


def snp(spark, cds_pos, alt, strand="+", cds=GENE):
    row = spark.createDataFrame([(cds, len(cds), cds_pos, strand, alt)], "cds string, cds_len int, cds_pos int, strand string, alt string")
    return consequence.snp_consequence(row).first()


@pytest.mark.parametrize(
    ("at", "alt", "want"),
    [
        (2, "C", ("M", "T", "Nonsyn", "lost_start")),
        (5, "T", ("A", "V", "Nonsyn", None)),
        (6, "C", ("A", "A", "Syn", None)),
        (7, "T", ("K", "*", "Nonsyn", "new_stop")),
        (10, "T", ("R", "C", "Nonsyn", None)),
        (13, "C", ("*", "Q", "Nonsyn", "lost_stop")),
    ],
)
def test_snp_consequences(spark, at, alt, want):
    r = snp(spark, at, alt)
    assert (r["ref_aa"], r["new_aa"], r["kind"]) == want[:3]
    assert [n for n in ("new_stop", "lost_stop", "lost_start") if r[n]] == ([want[3]] if want[3] else [])


def test_snp_on_the_other_strand(spark):
    rc = GENE[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for at, alt in ((2, "C"), (7, "T"), (13, "C")):
        a, b = snp(spark, at, alt), snp(spark, len(GENE) + 1 - at, alt.translate(str.maketrans("ACGT", "TGCA")), "-", rc)
        assert all(a[c] == b[c] for c in ("codon", "codon_pos", "codon_alt", "ref_aa", "new_aa", "degeneracy", "new_stop", "lost_stop", "lost_start"))


def test_codon_case_and_degeneracy(spark):
    r = snp(spark, 5, "T")
    assert (r["codon"], r["codon_alt"], r["degeneracy"]) == ("gCt", "gTt", "0")
    assert snp(spark, 6, "C")["degeneracy"] == "4" and snp(spark, 6, "N")["degeneracy"] == "-"
    place = lambda c: "TCAG".index(c[0]) * 16 + "TCAG".index(c[1]) * 4 + "TCAG".index(c[2])
    for codon, digits in {"TAG": "022", "TAA": "022", "TGA": "020", "CGA": "204", "ATG": "000", "ATT": "002", "AGA": "202", "TTA": "202", "TGG": "000"}.items():
        assert S.DEGENERACY[3 * place(codon) : 3 * place(codon) + 3] == digits


def test_indels(spark):
    ins = spark.createDataFrame([(GENE, 15, 3, "+", "AA", 13, 19)], "cds string, cds_len int, cds_pos int, strand string, seq string, pos long, e_end long")
    r = consequence.insertion_effects(ins).first()
    assert r["alt_cds"] == "ATGAAGCTAAACGTTAA" and r["frameshift"] and r["new_stop"] == 0 and r["lost_stop"] and not r["lost_start"]
    gone = spark.createDataFrame([(GENE, 15, 4, 5, "+")], "cds string, cds_len int, cds_left int, cds_right int, strand string")
    r = consequence.deletion_effects(gone).first()
    assert r["alt_cds"] == "ATGTAAACGTTAA" and r["frameshift"] and r["new_stop"] == 1 and not r["lost_start"]


def test_splice_motif(spark):
    row = spark.createDataFrame([(20, "S", 19, 30, "+", "ATGGCTAAAGTCCCCCCAGCGTTAA", 11)], "pos long, vartype string, prev_end long, next_start long, strand string, seq string, g_start long")
    bases = F.substr("seq", (F.col("prev_end") + 1 - F.col("g_start") + 1).cast("int"), F.lit(2))
    motif, place = consequence.splice_motif(bases, F.col("pos") - F.col("prev_end"))
    r = row.select(consequence.splice_site().alias("s"), motif.alias("m"), place.alias("p")).first()
    assert r["s"] and (r["m"], r["p"]) == ("Gt", 1)


def test_sequence_functions(spark):
    row = spark.createDataFrame([("ACGTN", "ACMR", "AT", "ATGGCTAAACGTTAAAC")], "a string, b string, c string, d string")
    r = row.select(S.revcomp(F.col("a")), S.revcomp_iupac(F.col("b")), S.to_iupac(F.lit("T"), F.lit("A")), S.to_iupac(F.lit("A"), F.lit("A")), S.translate_cds(F.col("d")), S.masked_length(F.col("a"))).first()
    assert tuple(r) == ("NACGT", "YKGT", "W", None, "MAKR*", 1)


def test_revcomp_twice(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([("".join(rng.choice("ACGTMRKYVHDB") for _ in range(40)),) for _ in range(50)], "s string")
    assert rows.filter(S.revcomp_iupac(S.revcomp_iupac(F.col("s"))) != F.col("s")).count() == 0


def test_bins(spark):
    rows = spark.createDataFrame([("1", p, 1) for p in (0, 5, 10, 15)], "chrom string, pos long, v int")
    got = bins.position_bins(rows, ["v"], 10, 5).orderBy("bin").collect()
    assert [(r["bin"] * 5, r["bin_pos"], r["v"]) for r in got] == [(0, 0, 2), (5, 5, 2), (10, 10, 2)]
    assert [r["n"] for r in bins.row_bins(rows, ["v"], 3).orderBy("bin").collect()] == [3, 1]


def test_ln_rising_is_exact():
    import math

    for x in (1e-3, 0.3, 5.0, 1e3, 2.5e7):
        for k in (0, 1, 7, 80):
            want = math.fsum(math.log(x + i) for i in range(k))
            assert abs(T.ln_rising(np.array([x]), np.array([float(k)]))[0] - want) <= 1e-11 * max(1, abs(want))


def test_p_values(spark):
    from math import comb

    rows = spark.createDataFrame([(k, n) for n in (0, 1, 7, 20, 1500) for k in {0, n // 3, n // 2, n}], "k int, n int")
    for r in rows.withColumn("p", T.binomial_p_value(F.col("k"), F.col("n"))).collect():
        less = min(r["k"], r["n"] - r["k"])
        assert abs(r["p"] - min(1, 2 * sum(comb(r["n"], i) for i in range(less + 1)) / 2 ** r["n"])) < 1e-9


def test_planted_locus_is_found(spark):
    rng, locus, span = np.random.default_rng(5), 6_000_000, 20_000_000
    pos = np.sort(rng.integers(1, span, 4000))
    podd = 0.5 * (1 - np.exp(-2.0 * np.abs(pos - locus) * 2 / span))
    res, sus = rng.binomial(30, 1 - podd), rng.binomial(30, (1 + podd) / 3)
    rows = spark.createDataFrame([("1", int(p), int(a), 30 - int(a), int(b), 30 - int(b)) for p, a, b in zip(pos, res, sus)], "chrom string, pos long, res_major int, res_minor int, sus_major int, sus_minor int")
    scores = mapping.map_score(rows, 178, 280, step=100_000, window=2_000_000)
    best = mapping.peaks(scores).first()
    assert abs(best["pos"] - locus) <= 500_000 and best["score"] > 100
    assert scores.count() == -(-(int(pos.max()) - int(pos.min())) // 100_000)
    assert scores.filter("score < 0").count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "chrom string, pos long, res_major int, res_minor int, sus_major int, sus_minor int")
    assert mapping.map_score(none, 10, 10).count() == 0
    assert bins.position_bins(none, ["res_major"], 10, 5).count() == 0
    assert quality.coverage_band(none, 0.5).count() == 0


def brute(lefts, rights):
    return {(a[0], b[0]) for a in lefts for b in rights if a[1] == b[1] and a[2] <= b[3] and a[3] >= b[2]}


def test_overlap_join_against_brute_force(spark):
    rng = random.Random(1)
    make = lambda n, size: [(i, rng.choice("ab"), s := rng.randrange(500), s + rng.randrange(size)) for i in range(n)]
    lefts, rights = make(150, 60), make(150, 200)
    a = spark.createDataFrame(lefts, "vid long, chrom string, start long, end long")
    b = spark.createDataFrame(rights, "f_id long, chrom string, r_start long, r_end long")
    for size in (7, 64, 10_000):
        got = overlap.overlap_join(a, b, size=size).select("vid", "f_id").collect()
        assert sorted(map(tuple, got)) == sorted(brute(lefts, rights))
    kept = overlap.overlap_join(a, b, keep_unmatched="vid", size=64)
    assert {r[0] for r in kept.select("vid").collect()} == set(range(150))


def test_insertions_stop_before_the_last_base(spark):
    v = spark.createDataFrame([("a", "1", 10, "I", 1), ("b", "1", 9, "I", 1), ("c", "1", 10, "S", 1), ("d", "1", 3, "D", 4)], "vid string, chrom string, pos long, vartype string, len int")
    f = spark.createDataFrame([("g", "1", 5, 10)], "f_id string, chrom string, f_start long, f_end long")
    got = {r["vid"]: (r["f_id"], r["hit_start"], r["hit_end"]) for r in overlap.features_of(v, f).collect()}
    assert got == {"a": (None, None, None), "b": ("g", 9, 9), "c": ("g", 10, 10), "d": ("g", 5, 6)}


def test_exon_positions_against_a_cursor(spark):
    exons = [("g", 11, 19), ("g", 30, 35), ("g", 50, 60)]
    rows = consequence.exon_offsets(spark.createDataFrame(exons, "gene string, e_start long, e_end long"))
    want, at = {}, 0
    for _, a, b in exons:
        for p in range(a, b + 1):
            at += 1
            want[p] = at
    places = spark.createDataFrame([(p,) for p in want], "pos long")
    got = places.join(rows, F.col("pos").between(F.col("e_start"), F.col("e_end"))).select("pos", consequence.cds_position()).collect()
    assert dict(map(tuple, got)) == want


def test_alignment(spark):
    genes = spark.createDataFrame([("g", "+", GENE), ("h", "-", "AACC"), ("i", "+", "ACG")], "gene string, strand string, cds string")
    edits = spark.createDataFrame([("g", "S", 2, 2, "C"), ("g", "I", 3, 3, "GG"), ("g", "D", 7, 9, None), ("h", "S", 1, 1, "G")], "gene string, vartype string, cds_left int, cds_right int, seq string")
    got = {r["gene"]: (r["ref"], r["alt"]) for r in consequence.gene_alignment(genes, edits).collect()}
    assert got == {"g": ("ATG--GCTAAACGTTAA", "ACGGGGCT---CGTTAA"), "h": ("GGTT", "GGTC"), "i": ("ACG", "ACG")}


def test_expressions_are_read_not_run(spark):
    calls = R.read_vcf(spark, VCF)
    pick = lambda x: {r[0] for r in calls.filter(expressions.condition(x)).select("pos").collect()}
    every = {r[0] for r in calls.select("pos").collect()}
    assert pick("POS > 0") == every and pick("nothing > 0") == set() and pick("not nothing > 0") == every
    assert pick("any('DP > 20')") == {200} and pick("-POS < -150 and QUAL >= 0") == {p for p in every if p > 150}
    assert pick("'A' in REF or POS in (200, 7)") >= {200}
    for bad in ("__import__('os')", "POS", "any(DP > 3)", "POS > (lambda: 1)()", "any('x.y > 1')", "[x for x in y]", "POS >", "atleast('2', 'DP > 1')", "DP[1] > 2", "any('any(1)')", "POS is None"):
        with pytest.raises(ValueError):
            expressions.condition(bad)


def test_sample_conditions(spark):
    calls = R.read_vcf(spark, VCF)
    dp = lambda s: variants.tag(s, "DP", "int")
    pick = lambda c: {r[0] for r in calls.filter(c).select("pos").collect()}
    assert pick(variants.any_sample(lambda s: dp(s) > 20)) == {200}
    assert pick(variants.all_samples(lambda s: dp(s) >= 20)) == {100, 200}
    assert pick(variants.at_least(2, lambda s: dp(s) > 1)) == {100}
    assert pick(variants.for_sample(2, lambda s: dp(s) > 1)) == {100}
    assert pick(variants.compare(1, 2, lambda a, b: dp(a) == dp(b))) == {100}
    assert pick("qual > 100 AND info['DP'] = '40'") == {100}
    assert variants.filtered(calls, "true", count=True, chunk=1, max_chunks=1).first()["n"] == 1
    assert calls.filter("key = '1@100'").select(*variants.split_key(F.col("key"))).first() == ("1", 100)


def test_fasta_over_many_splits(spark, tmp_path):
    """Sequences that go on over splits of any size, with headers and blank lines anywhere."""
    dice = random.Random(9)
    want = []
    for k in range(3):
        lines = []
        for i in range(dice.randint(1, 6)):
            seq = "".join(dice.choices("ACGTN", k=dice.choice([0, 1, 59, 60, 700, 4000])))
            want.append((f"s{k}_{i}", seq))
            lines += [f">s{k}_{i} about it", *(seq[x : x + 60] for x in range(0, len(seq), 60)), *[""] * dice.randint(0, 2)]
        (tmp_path / f"f{k}.fa").write_text("\n".join([*["ACGT"] * (k == 1), *lines, ""]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (1 << 20, 1000, 137):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert sorted(map(tuple, R.read_fasta(spark, str(tmp_path)).collect())) == sorted(want)
            chunks = R.read_fasta(spark, str(tmp_path), chunk=97).collect()
            assert sorted(map(tuple, chunks)) == sorted((n, i, s[97 * i : 97 * i + 97]) for n, s in want for i in range((len(s) + 96) // 97))
            assert sorted(map(tuple, R.fasta_index(spark, str(tmp_path)).collect())) == sorted((n, len(s)) for n, s in want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_gff_and_fasta(spark):
    gff = ["##gff", "chr1x\tsrc\tmRNA\t5\t9\t.\t+\t.\tID=a-g1-t1.2;Note=x", "chr2x\tsrc\tCDS\t5\t9\t0.5\t-\t0\tParent=q"]
    rows = R.read_gff(spark, gff, chrom="1", start=9, end=30, prefix="chr", suffix="x")
    assert rows.select("chrom", R.feature_name(F.col("attributes"), "ID", "-2"), R.feature_name(F.col("attributes"), "ID")).first() == ("1", "g1", "a-g1-t1")
    assert R.gff_config(["GENE_FEATURE\tgene#x\tCDS", "# no"]) == {"GENE_FEATURE": ["gene", "CDS"]}
    with pytest.raises(ValueError):
        R.gff_config(["NO_KEY\tx"])
    fasta = [">one first", "ACGT", "ACGA", ">two", "TT"]
    assert sorted(map(tuple, R.read_fasta(spark, fasta).collect())) == [("one", "ACGTACGA"), ("two", "TT")]
    chunks = R.read_fasta(spark, fasta, chunk=3)
    assert chunks.count() == 4
    regions = spark.createDataFrame([(1, "one", 2, 8), (2, "one", 3, 3), (3, "two", 1, 2)], "rid long, chrom string, start long, end long")
    assert {r["rid"]: r["seq"] for r in R.subsequences(regions, chunks, 3, "rid").collect()} == {1: "CGTACGA", 2: "G", 3: "TT"}


def test_unknown_chromosome_is_an_error(spark):
    rows, names = spark.createDataFrame([("1",), ("2",)], "chrom string"), spark.createDataFrame([("1", "one")], "chrom string, name string")
    assert R.translate_chromosomes(rows.filter("chrom = '1'"), names).first()["chrom"] == "one"
    with pytest.raises(Exception, match="no translation"):
        R.translate_chromosomes(rows, names).collect()


def test_design(spark):
    layout = primers.Layout()
    assert layout.regions() == (350, 47, 630, 120)
    rng = random.Random(2)
    seq = "".join(rng.choice("ACGT") for _ in range(1200))
    chunks = spark.createDataFrame([("1", i, seq[i * 100 : i * 100 + 100]) for i in range(12)], "chrom string, chunk long, seq string")
    primary = spark.createDataFrame([(1, "1", 600, seq[599], "ACGT"["ACGT".index(seq[599]) - 1], seq[599]), (2, "1", 100, "A", "C", "A")], "vid long, chrom string, pos long, ref string, alt string, major string")
    others = spark.createDataFrame([(9, "1", 590, seq[589:592], seq[589]), (8, "1", 610, seq[609], seq[609] + "A")], "o_id long, chrom string, o_pos long, o_ref string, o_alt string")
    rows = primers.templates(primary, others, chunks, 100, layout.flank).collect()
    assert [r["vid"] for r in rows] == [1]
    t = rows[0]["template"]
    assert len(t) == 801 and t[400] in "WSMKYR" and t[390:393] == "NNN" and t[411] == "N" and t[:390] == seq[199:589] and t[393:400] == seq[592:599]
    picked = spark.createDataFrame([(1, t)], "vid long, template string").select("*", *primers.pick_native(layout)).withColumn("direction", F.lit("fwd"))
    r = picked.select("*", *primers.product(layout.flank)).first()
    assert r["product_seq"].startswith(r["primer_left"]) and r["product_len"] == r["right_start"] - r["left_start"] + 1 and r["product_seq"][r["snp_place"] - 1] == t[400]


def test_external_reply_and_fallback(spark):
    text = "PRIMER_LEFT_0_SEQUENCE=ACGT\nPRIMER_RIGHT_0_SEQUENCE=TTTT\nPRIMER_LEFT_0=12,4\nPRIMER_RIGHT_0=99,4\n="
    row = spark.createDataFrame([(text,), ("=",)], "t string").select(*primers.reply(F.col("t"))).collect()
    assert tuple(row[0]) == ("ACGT", "TTTT", 12, 99) and tuple(row[1]) == (None, None, None, None)
    echoed = primers.run_external(spark.createDataFrame([(1, "A=1\n="), (2, "B=2\n=")], "vid long, request string").coalesce(1), ["cat"]).collect()
    assert {r["vid"]: r["reply"].split("\n")[0] for r in echoed} == {1: "A=1", 2: "B=2"}
    f, b = spark.createDataFrame([(1, "f")], "vid long, d string"), spark.createDataFrame([(1, "r"), (2, "r")], "vid long, d string")
    assert sorted(map(tuple, primers.best_direction(f, b).collect())) == [(1, "f"), (2, "r")]


def test_barcodes(spark):
    assert assays.parse_barcodes("AC, s1,GT ,s2") == [("AC", "s1"), ("GT", "s2")]
    with pytest.raises(ValueError):
        assays.parse_barcodes("AC,s1,GT")
    rows = assays.barcode_rows(spark.createDataFrame([("x", "L", "R")], "id string, primer_left string, primer_right string"), spark.createDataFrame([("AC", "s1")], "code string, sample string")).collect()
    assert {tuple(r) for r in rows} == {(1, "*", "L", "5prime", 1, "s1_x"), (3, "*", "R", "5prime", 1, "s1_x"), (2, "AC", "*", "5prime", 1, "s1_x"), (1, "*", "R", "5prime", 2, "s1_x"), (3, "*", "L", "5prime", 2, "s1_x"), (2, "AC", "*", "5prime", 2, "s1_x")}


def test_stream(spark, tmp_path):
    from segspark.streaming.calls import call_stream, filter_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.vcf").write_text("\n".join(VCF) + "\n")
    for _ in range(2):  # what was read is not read again
        filter_stream(call_stream(spark, str(tmp_path / "in")), "qual > 100", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r["pos"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [100]


def test_samples_and_small_forms(spark):
    rows = spark.createDataFrame([("1", p, p) for p in range(100)], "chrom string, pos long, vid long")
    a, b = (sorted(r["pos"] for r in mapping.balanced_sample(rows.repartition(n), 30, 10).collect()) for n in (1, 4))
    assert a == b and len(a) == 20 and sum(p < 30 for p in a) == 10
    ra, rb = T.beta_params_plain(F.lit(0.25), "res", 100.0, 50.0, 0.0)
    sa, sb = T.beta_params_plain(F.lit(0.5), "sus", 90.0, 60.0, 0.0)
    assert tuple(spark.range(1).select(ra, rb, sa, sb).first()) == (150.0, 50.0, 90.0, 60.0)
    names = spark.createDataFrame([("g-t1",), ("g-t2",), ("g",)], "n string").select(consequence.first_isoform(F.col("n"))).collect()
    assert [r[0] for r in names] == [True, False, True]
    line = spark.createDataFrame([("g", "A-", "AC")], "gene string, ref string, alt string").select(consequence.alignment_lines()).first()[0]
    assert line == ">g\nA-\nAC"


def test_map_score_opt_against_brute_force(spark, tmp_path):
    from segspark.plans.queries import QUERIES

    lines = [("A", "F", 3, 1, 11, 5, 17.0, 0.03, 0.04), ("A", "F", 700, 2, 52, 9, 40.0, 0.0, 0.1), ("A", "F", 5200, 1, 3, 1, 9.0, 0.08, 0.0), ("A", "F", 6105, 3, 77, 2, 50.0, 0.01, 0.07), ("R", "F", 10, 1, 39, 4, 1.0, 0.05, 0.02), ("R", "F", 400, 1, 8, 4, 30.0, 0.02, 0.09)]
    names = ("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_discount")
    spark.createDataFrame(lines, ", ".join(f"{n} {k}" for n, k in zip(names, ["string"] * 2 + ["long"] * 4 + ["double"] * 3))).withColumn("l_extendedprice", F.lit(1.0)).write.parquet(str(tmp_path / "lineitem.parquet"))
    snps = [(a + b, 1000 * o + n, int(q), round(100 * t), round(100 * d) + 5, p % 40) for a, b, o, n, p, _, q, t, d in lines]
    rising = lambda x, k: float(np.log(x + np.arange(k)).sum())

    def ll(mean, spread, size, eps, podd, k, n):
        c = max(mean * (1 - mean) / (spread * podd * (1 - podd) / size + eps * eps) - 1, 1e-3)
        return rising(mean * c, k) + rising((1 - mean) * c, n - k) - rising(c, n)

    both = lambda podd, eps, r: ll(1 - podd, 1.0, 178, eps, podd, r[2], r[2] + r[3]) + ll((1 + podd) / 3, 1 / 3, 280, eps, podd, r[4], r[4] + r[5])
    rate = 2 / (max(r[1] for r in snps) - min(r[1] for r in snps))
    want = {}
    for chrom in ("AF", "RF"):
        mine = [r for r in snps if r[0] == chrom]
        for at in range(min(r[1] for r in mine), max(r[1] for r in mine), 100_000):
            near = [r for r in mine if abs(r[1] - at) < 5_000_000]
            tested, background = [], []
            for eps in (10.0**e for e in range(-10, 0)):
                background.append(sum(both(0.5, eps, r) for r in near))
                tested += [sum(both(-0.5 * np.expm1(-2 * max(1, abs(r[1] - at)) * rate * (0.1 + 1.1 * j)), eps, r) for r in near) for j in range(10)]
            want[chrom, at] = max(0, max(tested) - max(background))
    got = {(r["chrom"], r["pos"]): r["score"] for r in QUERIES["map_score_opt"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and len(got) == 66 and max(got.values()) > 1
    assert all(abs(got[k] - want[k]) < 1e-3 for k in want)


def dna_of(gene):
    import hashlib

    return hashlib.md5(str(gene).encode()).hexdigest().translate(str.maketrans("0123456789abcdef", "ACGTACGTACGTACGT")) * 200


def test_gene_alignment_query_against_brute_force(spark, tmp_path):
    from segspark.plans.queries import QUERIES

    rng = random.Random(4)
    parts = [(1, 10), (2, 12), (3, 7), (4, 9)]
    # gene 1 and 2: all kinds, also over the ends of exons; 3: insertions alone; 4: nothing
    lines = [("N", "O", rng.choice([7, 8]), n, rng.randrange(1, 99), rng.randrange(1, 99)) for n in rng.sample(range(1000), 250)]
    lines += [("R", "O", 15, n, rng.randrange(1, 99), rng.randrange(1, 99)) for n in [*range(192, 200), *rng.sample(range(200, 999), 150), 398, 399]]
    lines += [("A", "O", 22, 500 + n, 6 + n, 12) for n in (3, 40, 90)]
    spark.createDataFrame(lines, "l_returnflag string, l_linestatus string, l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    want, kinds = {}, set()
    for gene, size in parts:
        chrom, start, n = "AFNOROAONFRF"[2 * (gene % 6) :][:2], gene * 7500, size * 100
        coding = [start + n // 3 * k + i for k in range(3) for i in range(n // 6)]
        last = {start + n // 3 * k + n // 6 - 1 for k in range(3)}
        cp, edits = {p: i + 1 for i, p in enumerate(coding)}, []
        for a, b, order, line, part, supp in lines:
            pos, long = order * 1000 + line, 2 + part % 5
            ref = "ACGTACGTAC"[part % 4 :][: long if supp % 5 == 1 else 1]
            alt = "ACGTACGTAC"[(part + 1 + supp % 3) % 4 :][: long if supp % 5 == 2 else 1]
            if a + b != chrom:
                continue
            if len(ref) > 1:
                hit = [cp[p] for p in range(pos, pos + len(ref) - 1) if p in cp]
                edits += [(min(hit), max(hit), "D", "")] if hit else []
            elif len(alt) > 1:
                edits += [(cp[pos], cp[pos], "I", alt[1:])] if pos in cp and pos not in last else []
            else:
                edits += [(cp[pos], cp[pos], "S", alt)] if pos in cp else []
        cds, done, changed, after = dna_of(gene)[: len(coding)], 0, {}, {}
        for left, right, kind, seq in sorted(edits):
            if left - (kind != "I") < done:
                continue
            done = right
            kinds.add((gene, kind))
            if kind == "I":
                after[left] = after.get(left, "") + seq
            else:
                changed |= dict.fromkeys(range(left, right + 1), seq or "-")
        ref = "".join(c + "-" * len(after.get(i, "")) for i, c in enumerate(cds, 1))
        alt = "".join(changed.get(i, c) + after.get(i, "") for i, c in enumerate(cds, 1))
        turn = (lambda x: x) if gene % 2 == 0 else (lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA")))
        want[gene] = (turn(ref), turn(alt))
    assert kinds == {(g, k) for g in (1, 2) for k in "SID"} | {(3, "I")}
    assert {r["gene"]: (r["ref"], r["alt"]) for r in QUERIES["gene_alignment"](spark, str(tmp_path)).collect()} == want


def test_revcomp_iupac_of_all_languages(spark, tmp_path):
    import hashlib

    from segspark.plans.queries import QUERIES

    docs = [(1, "ACMRn", "en"), (2, "äTGu", "de"), (3, "e\u0301Kx 😀", None), (4, None, "fr"), (5, "", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    turn = str.maketrans("ACTGactgMRVHmrvhKYBDkybd", "TGACtgacKYBDkybdMRVHmrvh")
    want = {i: t if t is None else hashlib.md5(t[::-1].translate(turn).encode()).hexdigest() for i, t, _ in docs}
    assert dict(map(tuple, QUERIES["revcomp_iupac"](spark, str(tmp_path)).collect())) == want


def test_primers_and_regions_of_whole_sequences(spark, tmp_path):
    import hashlib

    from segspark.plans.queries import QUERIES

    parts = [(g, 1 + g * 7 % 50) for g in range(1, 9)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    digits = str.maketrans("0123456789abcdef", "ACGTACGTACGTACGT")
    seqs = {g: hashlib.md5(str(g).encode()).hexdigest().translate(digits) * 200 for g, _ in parts}
    turned = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    count = lambda w: sum(s.startswith(w, i) for s in seqs.values() for i in range(len(s)))
    wanted = {s[g % 13 : g % 13 + 12] for g, s in seqs.items()}
    hits = {w: sum(count(x) for x in {w, turned(w)}) for w in wanted}
    assert dict(map(tuple, QUERIES["primer_matches"](spark, str(tmp_path)).collect())) == hits and min(hits.values()) >= 199
    got = dict(map(tuple, QUERIES["subsequence"](spark, str(tmp_path)).collect()))
    assert got == {g: seqs[g][10 : 10 + size * 100 - 1] for g, size in parts}


def test_barcodes_are_bounded_and_not_joined(spark, capsys):
    one = spark.createDataFrame([("x", "L", "R")], "id string, primer_left string, primer_right string")
    codes = spark.range(assays.MOST_BARCODES + 1).selectExpr("hex(id) AS code", "concat('s', id) AS sample")
    with pytest.raises(ValueError, match="barcodes"):
        assays.barcode_rows(one, codes)
    assert assays.barcode_rows(one, codes.limit(0)).count() == 0
    rows = assays.barcode_rows(one, codes.limit(3))
    assert rows.count() == 18
    rows.explain()
    assert "Join" not in capsys.readouterr().out


def test_binomial_draws_against_sums(spark):
    dice = random.Random(3)
    rows = [(i, dice.choice([0.0, 1e-6, 0.03, 0.4, 0.5, 0.9, 1.0]), dice.random()) for i in range(300)]
    got = spark.createDataFrame(rows, "i long, p double, u double").select("i", T.binomial_draw(20, F.col("p"), F.col("u")).alias("k")).collect()
    for r in got:
        _, p, u = rows[r["i"]]
        below = [sum(math.comb(20, j) * p**j * (1 - p) ** (20 - j) for j in range(k + 1)) for k in range(20)]
        assert r["k"] == sum(x < u for x in below)


def test_simulated_pools_follow_the_curve(spark):
    places = spark.range(400).select(F.lit("c").alias("chrom"), (F.col("id") * 50_000).alias("pos"))
    made = mapping.simulate_pools(places, 10_000_000, draws=10)
    assert made.count() == 4000 and made.filter("distance = 0 AND (pool_count < 178 OR read_count < 20)").count() == 0
    podd = T.odd_crossovers(F.col("distance"), 2 / 17_645_844)
    off = made.agg(F.avg(F.col("pool_count") / 178 - (1 - podd)), F.avg(F.col("read_count") / 20 - F.col("pool_count") / 178), F.stddev(F.col("pool_count") / 178 - (1 - podd))).first()
    assert abs(off[0]) < 0.005 and abs(off[1]) < 0.01 and 0.02 < off[2] < 0.04
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, mapping.simulate_pools(places, 10_000_000, draws=10).collect()))


def test_wide_windows_sum_as_pair_by_pair(spark, monkeypatch):
    """Steps with many and without SNPs, SNPs on grid points, a large count, windows of whole and broken steps."""
    import random

    dice = random.Random(3)
    places = [1000, 9_000] + [1000 + dice.choice([100 * dice.randint(0, 70), dice.randint(0, 900), dice.randint(0, 7900)]) for _ in range(400)]
    rows = [(c, x, dice.randint(0, 40), dice.randint(0, 9), dice.randint(0, 15), dice.randint(0, 40)) for x in places for c in "AB"] + [("A", 3333, 400, 20, 5, 5), (None, 5, 1, 1, 1, 1)]
    snps = spark.createDataFrame(rows, "chrom string, pos long, res_major int, res_minor int, sus_major int, sus_minor int")
    rates = spark.createDataFrame([(2e-4,)], "rate double")
    for window in (2000, 1650):
        got = []
        for wide in (16, 1000):
            monkeypatch.setattr(mapping, "WIDE", wide)
            found = mapping.sums_by_grid(snps, rates, 178, 280, 100, window, [1e-10, 1e-2, 1e-1], [0.1, 10.0], [1e-2, 1e-2, 1e-1])
            assert ("FlatMapGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()) == (wide == 16)
            got.append({(r["chrom"], r["i"], r["theta"]): (r["ll"], r["ll0"]) for r in found.collect()})
        assert got[0].keys() == got[1].keys() and len(got[0]) == 2 * 80 * 6
        assert all(abs(x - y) < 1e-8 for k, v in got[1].items() for x, y in zip(v, got[0][k]))


def test_binomial_draws_are_made_together():
    """As term by term, with certain and impossible successes; no plan repeats a term for each row."""
    import numpy as np

    dice = np.random.default_rng(4)
    p, u = np.concatenate(([0.0, 1.0, 0.5], dice.random(9000))), np.concatenate(([0.3, 0.3, 0.0], dice.random(9000)))
    for n in (20, 178):
        got = T.draw_binomial(n, p * 0.9 if n > 20 else p, u)
        for x, y, k in zip((p * 0.9 if n > 20 else p).tolist(), u.tolist(), got.tolist()):
            term = total = (1 - x) ** n
            want = 0
            while total < y and want < n and x < 1:
                want += 1
                term = term * (x / (1 - x)) * (n - want + 1) / want
                total += term
            assert k == (n if x >= 1 else want)


def test_many_features_are_not_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([("v", "1", 5, "S", 1)], "vid string, chrom string, pos long, vartype string, len int")
    features = spark.createDataFrame([(1, "1", 1, 9), (2, "1", 5, 5), (3, "1", 6, 9)], "f_id long, chrom string, f_start long, f_end long")
    for most in (2, 3):
        monkeypatch.setattr(overlap, "BROADCAST_FEATURES", most)
        found = overlap.features_of(rows, features)
        assert sorted(r["f_id"] for r in found.collect()) == [1, 2]
        assert ("MERGE" in found._jdf.queryExecution().analyzed().toString().upper()) == (most == 2)


def test_words_are_counted_where_they_are_read(spark):
    """Odd sizes, other letters in words and sequences, words that read alike both ways, short and empty chunks."""
    dice = random.Random(9)
    chunks = ["".join(dice.choices("ACGTN", [8, 8, 8, 8, 1], k=dice.randint(0, 60))) for _ in range(200)] + ["NNNNNNNNNNNN", "ACGTACGTACGT", "ACéGTACGTA", None, "A"]
    frame = spark.createDataFrame([(x,) for x in chunks], "chunk_seq string")
    turn = str.maketrans("ACGT", "TGCA")
    for size in (1, 3, 4, 7, 28):
        asked = {x[i : i + size] for x in chunks if x for i in range(0, max(0, len(x) - size + 1), 5)} | {"ACGT"[:size], "N" * size, "T" * size}
        asked = {x for x in asked if len(x) == size and x.isascii()}
        found = primers.matches(spark.createDataFrame([(x,) for x in asked], "primer string"), frame, size)
        assert ("MapInArrow" in found._jdf.queryExecution().executedPlan().toString()) == (size <= primers.PACKED)
        words = [x[i : i + size] for x in chunks if x for i in range(len(x) - size + 1)]
        assert {r["primer"]: r["hits"] for r in found.collect()} == {p: sum(w in {p, p[::-1].translate(turn)} for w in words) for p in asked}
