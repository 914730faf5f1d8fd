"""Runs from files to files, and the cache of parsed tables."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from segspark.operators import primer_pairs as P
from segspark.plans import runs
from segspark.sources import sinks
from segspark.sources.cache import cached

TURN = str.maketrans("ACGT", "TGCA")


def table(path, rows):
    """A normalised table of (chrom, pos, ref, alt, major, minor, filter, type, segr, res AD, sus AD)."""
    lines = ["##source=made up", *sinks.pooled_header(["res", "sus"])]
    for chrom, pos, ref, alt, major, minor, flags, kind, segr, a, b in rows:
        lines.append("\t".join(map(str, (chrom, pos, ".", ref, alt, major, minor, 500, flags, kind, segr, "NA", "GT:AD:DP", f"0/1:{a}:30", f"0/1:{b}:30"))))
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def read(path):
    return sorted(x for f in glob.glob(f"{path}/part*") for x in open(f).read().splitlines())


def test_mapping_finds_the_locus(spark, tmp_path):
    dice, rows = random.Random(1), []
    for pos in range(50_000, 20_000_000, 40_000):
        near = max(0, 1 - abs(pos - 8_000_000) / 6_000_000)
        a = sum(dice.random() < 0.5 + 0.48 * near for _ in range(30))
        b = sum(dice.random() < 0.5 - 0.16 * near for _ in range(30))
        rows.append(("c1", pos, "A", "G", "A", "G", "PASS" if pos % 120_000 else "LowQual", "SNP", f"{a + b},{60 - a - b}", f"{a},{30 - a}", f"{b},{30 - b}"))
    source, cache = table(tmp_path / "calls", rows), str(tmp_path / "cache")
    options = runs.MapOptions(window_size=1_000_000, min_ratio=0.2, max_ratio=0.95)
    runs.run_map(spark, source, str(tmp_path / "out"), "res", "sus", 178, 280, options, cache)
    made = [line.split(",") for f in glob.glob(f"{tmp_path}/out/chrom=c1/part*") for line in open(f)]
    best = max(made, key=lambda r: float(r[2]))
    assert best[0] == "c1" and abs(int(best[1]) - 8_000_000) < 2_000_000 and len(made) == 200
    with pytest.raises(Exception, match="(?i)exists"):
        runs.run_map(spark, source, str(tmp_path / "out"), "res", "sus", 178, 280, options, cache)
    runs.run_map(spark, source, str(tmp_path / "opt"), "res", "sus", 178, 280, runs.MapOptions(window_size=200_000, resolution=2_000_000, opt_eps=True, opt_recombination=True, chrom_size=2e7), cache)
    assert glob.glob(f"{tmp_path}/opt/chrom=c1/part*")


def test_cache_reads_again_only_what_changed(spark, tmp_path):
    source, root, loads = tmp_path / "in.txt", str(tmp_path / "kept"), []
    source.write_text("a\nb\n")

    def get(options=None, renew=False):
        return sorted(r[0] for r in cached(spark, str(source), root, "t", options or {}, lambda: loads.append(1) or spark.read.text(str(source)), renew).collect())

    assert get() == get() == ["a", "b"] and len(loads) == 1
    assert get({"x": 1}) == ["a", "b"] and len(loads) == 2
    source.write_text("a\nb\nc\n")
    assert get() == ["a", "b", "c"] and get() == ["a", "b", "c"] and len(loads) == 3
    get(renew=True)
    assert len(loads) == 4 and not glob.glob(f"{root}/.t-*[!c]") and len(glob.glob(f"{root}/t-*")) == 3
    with pytest.raises(FileNotFoundError):
        cached(spark, str(tmp_path / "none"), root, "t", {}, lambda: None)


GENOME = "C" * 10 + "ATGGCTAAAGTCCCCCCAGCGTTAAGGGGG" + "C" * 60
CONFIG = ["GENE_FEATURE\tgene", "CODING_FEATURE\tCDS", "GENE_TAG\tID", "CODING_TAG\tParent", "CROP_CHR_GFF_START\tchr"]


def test_annotation_of_files(spark, tmp_path):
    (tmp_path / "genome.fa").write_text(">1 a chromosome\n" + "\n".join(GENOME[i : i + 7] for i in range(0, len(GENOME), 7)) + "\n>2\nACGT\n")
    feature = lambda kind, a, b, note: f"chr1\tmade\t{kind}\t{a}\t{b}\t.\t+\t.\t{note}"
    (tmp_path / "genes.gff").write_text("##gff\n" + "\n".join([feature("gene", 11, 40, "ID=g1.x"), feature("CDS", 11, 19, "Parent=g1.1"), feature("CDS", 30, 35, "Parent=g1.1"), feature("CDS", 11, 12, "Parent=g1.2"), feature("gene", 70, 80, "ID=g2.x")]) + "\n")
    snp = lambda pos, ref, alt, flags="PASS": ("1", pos, ref, alt, ref, alt, flags, "SNP", "3,4", "1,2", "2,2")
    source = table(tmp_path / "calls", [snp(15, "C", "T"), snp(20, "G", "A"), snp(5, "C", "G"), snp(33, "T", "C", "LowQual"), snp(14, "GCT", "G"), snp(75, "C", "A")])
    args = spark, source, str(tmp_path / "genes.gff"), str(tmp_path / "genome.fa"), CONFIG
    runs.run_annotate(*args, str(tmp_path / "out"), runs.AnnotateOptions(alignments=True))
    gene = lambda n: f"g1\t1\t11\t40\t+\t{n}"
    got = read(tmp_path / "out")
    assert f"1\t15\t>T\tC\tT\tPASS\tCDS\t{gene(5)}\t15\t5\t2\tNonsyn\tA\tV\tgCt\t0" in got
    assert any(x.endswith(f"splicesite\t{gene(10)}\t1\tGt\tsplicechange") for x in got) and any(x.endswith("PASS\tintergenic") for x in got)
    assert any(x.endswith(f"CDS,2\t{gene(4)}\t15\t4\t5\t2\tnew_stop (1),frameshift") for x in got) and any("intronic/noncoding\tg2" in x for x in got) and len(got) == 6
    blocks = "\n".join(x for f in sorted(glob.glob(f"{tmp_path}/out-genes/part*")) for x in open(f).read().splitlines())
    assert blocks == ">g1\nATGGCTAAACGTTAA\nATG--TAAACGTCAA"
    runs.run_annotate(*args, str(tmp_path / "mut"), runs.AnnotateOptions(mut=True, filters=("LowQ",), chrom="1", start=1, end=40))
    mut = read(tmp_path / "mut")
    assert len(mut) == 4 and any(x.split("\t")[4] == "nonsynonymous" for x in mut) and not any(x.startswith("1\t33") for x in mut)
    assert open(glob.glob(f"{tmp_path}/mut-header/part*")[0]).read().startswith("chr\tstart\tend\tsample")


def test_designs_of_files(spark, tmp_path):
    dice = random.Random(12)
    c1, c2 = ("".join(dice.choices("ACGT", k=n)) for n in (9000, 3000))
    c1 = c1[:6000] + c1[1000:1900] + c1[6900:]  # a second copy of what lies around base 1,450
    (tmp_path / "genome.fa").write_text("".join(f">{n}\n" + "\n".join(s[i : i + 60] for i in range(0, len(s), 60)) + "\n" for n, s in (("c1", c1), ("c2", c2))))
    snps = [("c1", p, c1[p - 1], "ACGT"[("ACGT".index(c1[p - 1]) + 1) % 4]) for p in (1450, 2500, 3990, 4500, 8990, 200)] + [("c2", 1500, c2[1499], "ACGT"[("ACGT".index(c2[1499]) + 1) % 4])]
    rows = [(c, p, r, a, r, a, "PASS", "SNP", "30,30", "20,10", "10,20") for c, p, r, a in snps]
    rows += [("c1", 2480, c1[2479], "T" if c1[2479] != "T" else "A", "A", "T", "LowQual", "SNP", "1,1", "1,1", "1,1")]
    source = table(tmp_path / "calls", rows)
    runs.run_design(spark, source, str(tmp_path / "genome.fa"), str(tmp_path / "out"))
    lines = [x.split("\t") for x in read(tmp_path / "out")]
    found = {(x[0], int(x[1])): x for x in lines}
    assert {(c, p) for c, p, *_ in snps} - set(found) >= {("c1", 1450), ("c1", 8990), ("c1", 200)} and len(found) >= 3
    for (chrom, pos), x in found.items():
        seq, (way, left, right) = {"c1": c1, "c2": c2}[chrom], x[11:14]
        masked = list(seq)
        if chrom == "c1":
            masked[2479] = "N"
        template = "".join(masked[pos - 401 : pos + 400])
        template = template[:400] + "R" + template[401:]
        template = template if way == "fwd" else template.translate(TURN)[::-1]
        want = P.best_pair(template, runs.DesignOptions().layout, P.PickSettings())
        assert (left, right) == want[2:4] and int(x[14]) == len(x[16]) == want[1] - want[0] + 1 and x[15] == str(x[16].count("N"))
    again = runs.designs(spark, source, str(tmp_path / "genome.fa"), runs.DesignOptions(legal=("nothing",)))
    assert again.filter(F.lit(True)).count() == 0
