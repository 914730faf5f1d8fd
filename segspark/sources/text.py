"""Readers of tab-separated genomics files.  Each is one text scan and projections;
missing values (``NA``, ``na``, ``.``, ``./.``) become nulls."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Columns of the normalised and the primer table.
POOLED_COLUMNS = ["chrom", "pos", "id", "ref", "alt", "major", "minor", "qual", "filter", "type", "segr", "hapsc", "format"]
PRIMER_COLUMNS = ["chrom", "pos", "id", "ref", "alt", "major", "minor", "qual", "filter", "type", "segr", "direction", "primer_left", "primer_right", "product_len", "n_count", "product_seq"]


def lines(spark: SparkSession, source: str | list[str]) -> DataFrame:
    """A ``value`` column of a path, or of a list of lines."""
    if isinstance(source, list):
        return spark.createDataFrame([(x,) for x in source], "value string")
    return spark.read.text(source)


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over as many partitions as there are cores if they come in fewer (one small
    file), for work that costs far more than moving them; larger inputs stay as they are.
    What decides is the estimated size of a scan, so nothing runs for it."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows if size >= cores * split else rows.repartition(cores)


def header(text: DataFrame) -> list[str]:
    """Columns of the last line before the data that starts with one #."""
    row = text.filter(F.col("value").startswith("#") & ~F.col("value").startswith("##")).select("value").limit(1).collect()
    return row[0][0].lstrip("#").rstrip("\r\n").split("\t") if row else []


def fields(text: DataFrame) -> DataFrame:
    """``value`` and its tab-separated fields ``f``, without comments and empty lines."""
    return text.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("f", F.split("value", "\t"))


def missing(x: Column, *words: str) -> Column:
    return F.when(~x.isin(*(words or (".", "NA", "na", ""))), x)


def tag(names: Column, values: Column, name: str) -> Column:
    """The value that stands where ``name`` stands among the names."""
    at = F.array_position(names, name)
    return F.when(at > 0, F.get(values, (at - 1).cast("int")))


def counts(text: Column) -> Column:
    """Comma-separated whole numbers; parts that aren't become nulls."""
    return F.transform(F.split(text, ","), lambda x: x.try_cast("int"))


def read_pooled(spark: SparkSession, source: str | list[str], res: str, sus: str, parents: tuple[str, str] | None = None) -> DataFrame:
    """SNPs with segregation counts of two pools, by the names of their columns."""
    text = lines(spark, source)
    names = header(text)
    f = lambda name: F.get("f", F.lit(names.index(name)))
    at = {c: F.get("f", F.lit(i)) for i, c in enumerate(POOLED_COLUMNS)}
    rows = fields(text).filter((at["segr"] != "NA") & (at["type"] == "SNP"))
    format = F.split(at["format"], ":")
    of = lambda sample, name: tag(format, F.split(f(sample), ":"), name)
    ad = {p: counts(of(s, "AD")) for p, s in (("res", res), ("sus", sus))}
    columns = [
        at["chrom"].alias("chrom"),
        at["pos"].try_cast("long").alias("pos"),
        F.array(*(at[c] for c in ("major", "minor"))).alias("alleles_res"),
        F.array(*(at[c] for c in ("major", "minor"))).alias("alleles_sus"),
        at["qual"].try_cast("double").alias("qual"),
        missing(at["hapsc"]).try_cast("double").alias("hapsc"),
        F.split(F.upper(at["filter"]), "[;,]").alias("flags"),
        at["type"].alias("type"),
        at["segr"].alias("segr"),
    ]
    for p, s in (("res", res), ("sus", sus)):
        columns += [F.get(ad[p], F.lit(0)).alias(f"{p}_major"), F.get(ad[p], F.lit(1)).alias(f"{p}_minor"), of(s, "GT").alias(f"geno_{p}")]
    for i, s in enumerate(parents or (), 1):
        columns.append(of(s, "GT").alias(f"parent{i}"))
    return rows.select(*columns)


def read_normalised(spark: SparkSession, source: str | list[str]) -> DataFrame:
    """Variants of a normalised table, of all types, as primer design takes them: ``chrom, pos,
    id, ref, alt, major, minor, qual, flags (array), type, segr_major, segr_minor``."""
    at = {c: F.get("f", F.lit(i)) for i, c in enumerate(POOLED_COLUMNS)}
    segr = counts(missing(at["segr"]))
    return fields(lines(spark, source)).select(
        at["chrom"].alias("chrom"),
        at["pos"].try_cast("long").alias("pos"),
        missing(at["id"]).alias("id"),
        at["ref"].alias("ref"),
        at["alt"].alias("alt"),
        missing(at["major"], "NA").alias("major"),
        missing(at["minor"], "NA").alias("minor"),
        at["qual"].try_cast("double").alias("qual"),
        F.split(at["filter"], "[;,]").alias("flags"),
        at["type"].alias("type"),
        F.get(segr, F.lit(0)).alias("segr_major"),
        F.get(segr, F.lit(1)).alias("segr_minor"),
    )


def read_two_sample_calls(spark: SparkSession, source: str | list[str], with_parents: bool = False) -> DataFrame:
    """The older call table without INFO: FORMAT in column 8, then parents if any, then the
    pools res and sus; the chromosome is what follows ``chr``."""
    f = lambda i: F.get("f", F.lit(i))
    format, first = F.split(f(7), ":"), 10 if with_parents else 8
    of = lambda i, name: tag(format, F.split(f(i), ":"), name)
    columns = [F.regexp_extract(f(0), ".*chr(.*)", 1).alias("chrom"), f(1).try_cast("long").alias("pos"), F.array(f(3), f(4)).alias("alleles_res"), F.array(f(3), f(4)).alias("alleles_sus"), f(5).try_cast("double").alias("qual"), F.split(F.upper(f(6)), "[;,]").alias("flags")]
    for p, i in (("res", first), ("sus", first + 1)):
        ad = counts(of(i, "AD"))
        columns += [F.get(ad, F.lit(0)).alias(f"{p}_major"), F.get(ad, F.lit(1)).alias(f"{p}_minor"), of(i, "GT").alias(f"geno_{p}")]
    columns += [of(8 + i, "GT").alias(f"parent{i + 1}") for i in range(2) if with_parents]
    return fields(lines(spark, source)).select(*columns)


def read_vcf(spark: SparkSession, source: str | list[str], drop_reference: bool = False) -> DataFrame:
    """``key (chrom@pos), chrom, pos, id, ref, alt (array), qual, filter (array), info (map),
    format (array), samples``: an array of (num, name, tags) with every tag as text;
    samples that are ``./.`` are left out but keep their 1-based numbers."""
    text = lines(spark, source)
    rows = parse_vcf(text, header(text)[9:])
    return rows.filter(F.upper("ref") != F.upper(F.array_join("alt", ","))) if drop_reference else rows


def parse_vcf(text: DataFrame, names: list[str]) -> DataFrame:
    """Lines (``value``) with samples of these names; see :func:`read_vcf`."""
    f = lambda i: F.get("f", F.lit(i))
    format = F.split(f(8), ":")

    def sample(i: int, name: str) -> Column:
        values = F.split(f(9 + i), ":")
        n = F.least(F.size(format), F.size(values))
        tags = F.map_from_arrays(F.slice(format, F.lit(1), n), F.slice(values, F.lit(1), n))
        return F.when(~f(9 + i).startswith("./."), F.struct(F.lit(i + 1).alias("num"), F.lit(name).alias("name"), tags.alias("tags")))

    samples = F.array_compact(F.array(*(sample(i, n) for i, n in enumerate(names)))) if names else F.array().cast("array<struct<num:int,name:string,tags:map<string,string>>>")
    return fields(text).select(
        F.concat(f(0), F.lit("@"), f(1)).alias("key"),
        f(0).alias("chrom"),
        f(1).try_cast("long").alias("pos"),
        missing(f(2), ".").alias("id"),
        f(3).alias("ref"),
        F.split(f(4), ",").alias("alt"),
        f(5).try_cast("double").alias("qual"),
        F.split(f(6), ";").alias("filter"),
        F.str_to_map(f(7), F.lit(";"), F.lit("=")).alias("info"),
        format.alias("format"),
        samples.alias("samples"),
    )


def read_allele_table(spark: SparkSession, source: str | list[str]) -> DataFrame:
    """The oldest table: whitespace, one header line, alleles and counts of sus, res, both
    (skipped) and two parents."""
    text = lines(spark, source).withColumn("f", F.split(F.trim("value"), "\\s+")).filter(F.get("f", F.lit(1)).try_cast("long").isNotNull())
    f = lambda i: F.get("f", F.lit(i))
    columns = [f(0).alias("chrom"), f(1).try_cast("long").alias("pos")]
    for name, at in (("sus", 2), ("res", 6), ("um", 14), ("tn1", 18)):
        columns += [f(at).alias(f"{name}_a1"), f(at + 1).alias(f"{name}_a2"), f(at + 2).try_cast("int").alias(f"{name}_n1"), f(at + 3).try_cast("int").alias(f"{name}_n2")]
    return text.select(*columns)


def read_primers(spark: SparkSession, source: str | list[str]) -> DataFrame:
    """Primer rows that have an id."""
    rows = fields(lines(spark, source)).select(*(F.get("f", F.lit(i)).alias(c) for i, c in enumerate(PRIMER_COLUMNS)))
    return rows.filter("id <> '.'").withColumn("pos", F.col("pos").try_cast("long"))


def read_gff(spark: SparkSession, source: str | list[str], chrom: str | None = None, start: int | None = None, end: int | None = None, prefix: str = "", suffix: str = "") -> DataFrame:
    """Features with their attributes as a map; only those that overlap a region if one is
    given.  ``prefix`` and ``suffix`` are cut off chromosome names."""
    f = lambda i: F.get("f", F.lit(i))
    name = f(0)
    name = F.when(name.startswith(prefix), F.substr(name, F.lit(len(prefix) + 1))).otherwise(name) if prefix else name
    name = F.when(name.endswith(suffix), F.substr(name, F.lit(1), F.length(name) - len(suffix))).otherwise(name) if suffix else name
    rows = fields(lines(spark, source)).select(name.alias("chrom"), f(1).alias("source"), f(2).alias("type"), f(3).try_cast("long").alias("start"), f(4).try_cast("long").alias("end"), f(5).try_cast("double").alias("score"), f(6).alias("strand"), f(7).alias("frame"), F.str_to_map(f(8), F.lit(";"), F.lit("=")).alias("attributes"))
    for given, test in ((chrom, F.col("chrom") == chrom), (start, F.col("end") >= start), (end, F.col("start") <= end)):
        rows = rows.filter(test) if given is not None else rows
    return rows


#: Keys of a feature file's configuration.
GFF_KEYS = {"GENE_FEATURE", "CODING_FEATURE", "OTHER_FEATURES", "CROP_CHR_GFF_START", "CROP_CHR_GFF_END", "ISOFORM_FEATURE", "GENE_SPLITSTRING", "ISOFORM_SPLITSTRING", "CODING_SPLITSTRING", "SPLITSTRING", "GENE_TAG", "ISOFORM_TAG", "CODING_TAG", "TAG", "GFF_SORTED"}


def gff_config(rows: list[str]) -> dict[str, list[str]]:
    """Values of each key; ``feature#name`` stands for the feature.  Unknown keys are errors."""
    out = {}
    for row in rows:
        key, *values = row.rstrip("\r\n").split("\t")
        if not key or key.startswith("#"):
            continue
        if key not in GFF_KEYS:
            raise ValueError(f"unknown key {key!r}")
        out[key] = [v.split("#")[0] for v in values if v]
    return out


def feature_name(attributes: Column, name: str, pairs: str = "") -> Column:
    """A name from attribute ``name``: for each (character, column) of ``pairs`` split and
    take the 1-based column, then cut at the last dot."""
    out = F.try_element_at(attributes, F.lit(name))
    for char, column in zip(pairs[::2], pairs[1::2]):
        out = F.get(F.split(out, "\\Q" + char + "\\E"), F.lit(int(column) - 1))
    return F.regexp_replace(out, "\\.[^.]*$", "")


#: Bases that a task puts together before it hands them on.
PIECE = 1 << 16


def _fasta_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, block, value) of splits in their order as stretches of sequence: ``part`` counts
    the headers met in the split (0: what goes on from the split before), ``at`` is the place
    in the part, ``name`` that of its header.  Each part has a row even if it has no bases."""
    key, part, name, at, parts, size = None, 0, None, 0, [], 0
    rows: list[tuple] = []

    def close() -> None:
        nonlocal at, parts, size
        rows.append((*key, part, name, at, "".join(parts)))
        at, parts, size = at + size, [], 0

    for batch in batches:
        for file, block, line in zip(*(batch.column(c).to_pylist() for c in range(3))):
            if (file, block) != key:
                if key is not None:
                    close()
                key, part, name, at = (file, block), 0, None, 0
            if line.startswith(">"):
                close()
                part, at = part + 1, 0
                name = (line[1:].split(None, 1) or [""])[0] if not line[1:2].isspace() else ""
            else:
                line = "".join(line.split())
                parts.append(line)
                size += len(line)
                if size >= PIECE:
                    close()
        if rows:
            yield _piece_batch(rows)
            rows = []
    if key is not None:
        close()
        yield _piece_batch(rows)


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"file": pa.string(), "block": pa.int64(), "part": pa.int32(), "name": pa.string(), "at": pa.int64(), "seq": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))


def fasta_pieces(spark: SparkSession, source: str | list[str]) -> DataFrame:
    """``head`` (which sequence of which file), ``chrom, at`` (from 0), ``seq``: stretches of sequences,
    in any order, each as far as its split of the file goes.

    Splits are read by many tasks; each counts the bases of what it begins with and of what it
    ends with.  One row for each split tells the next ones which sequence goes on, and where."""
    if isinstance(source, list):
        text = spark.createDataFrame([(x,) for y in source for x in y.split("\n")], "value string").coalesce(1).select(F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), "value")
    else:
        text = spark.read.text(source).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    pieces = text.mapInArrow(_fasta_pieces, "file string, block long, part int, name string, at long, seq string")
    ends = pieces.groupBy("file", "block").agg(F.max(F.struct("part", (F.col("at") + F.length("seq")).alias("bases"), "name")).alias("last"))
    in_file = Window.partitionBy("file").orderBy("block")
    counted = ends.withColumn("run", F.sum((F.col("last.part") > 0).cast("int")).over(in_file))
    in_run = Window.partitionBy("file", "run").orderBy("block")
    first = lambda c: F.first(c).over(in_run)  # noqa: E731  the split that holds the header
    so_far = F.struct(F.sum("last.bases").over(in_run).alias("bases"), first("last.name").alias("name"), first("block").alias("block"), first("last.part").alias("part"))
    carried = counted.withColumn("so_far", so_far).select(F.col("file").alias("_file"), F.col("block").alias("_block"), F.lag("so_far").over(in_file).alias("before"))
    rows = pieces.join(carried, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    goes_on = F.col("part") == 0
    mine = lambda c: F.when(goes_on, F.col(f"before.{c}")).otherwise(F.col(c))
    head = F.struct("file", mine("block").alias("block"), mine("part").alias("part"))
    place = F.when(goes_on, F.col("before.bases") + F.col("at")).otherwise(F.col("at"))
    return rows.select(head.alias("head"), mine("name").alias("chrom"), place.alias("at"), "seq").filter("chrom IS NOT NULL")


def fasta_index(spark: SparkSession, source: str | list[str]) -> DataFrame:
    """``chrom, bases`` of each sequence."""
    sums = fasta_pieces(spark, source).groupBy("head", "chrom").agg(F.sum(F.length("seq")).cast("long").alias("bases"))
    return sums.select("chrom", "bases")


def read_fasta(spark: SparkSession, source: str | list[str], chunk: int | None = None) -> DataFrame:
    """``chrom, seq``; with ``chunk``: ``chrom, chunk (from 0), seq`` in pieces of so many bases.

    No task holds more than some stretches of a sequence unless whole ones are asked for;
    text without line ends is a line, which is read as one."""
    pieces = fasta_pieces(spark, source)
    if chunk is None:
        sorted_ = F.array_sort(F.collect_list(F.struct("at", "seq")))
        return pieces.groupBy("head", "chrom").agg(F.array_join(F.transform(sorted_, lambda x: x["seq"]), "").alias("seq")).select("chrom", "seq")
    last = F.col("at") + F.length("seq") - 1
    spans = pieces.filter("seq <> ''").withColumn("chunk", F.explode(F.sequence(F.floor(F.col("at") / chunk), F.floor(last / chunk))))
    from_ = F.greatest(F.col("at"), F.col("chunk") * chunk)
    size = F.least(last, (F.col("chunk") + 1) * chunk - 1) - from_ + 1
    cut = spans.select("head", "chrom", "chunk", from_.alias("at"), F.substr("seq", (from_ - F.col("at") + 1).cast("int"), size.cast("int")).alias("seq"))
    listed = F.array_sort(F.collect_list(F.struct("at", "seq")))
    return cut.groupBy("head", "chrom", "chunk").agg(F.array_join(F.transform(listed, lambda x: x["seq"]), "").alias("seq")).select("chrom", "chunk", "seq")


def chunked(sequences: DataFrame, size: int) -> DataFrame:
    """``chrom, chunk (from 0), seq``: sequences in pieces of ``size`` bases."""
    pieces = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{size}}}+"), F.lit(0))  # one pass over the sequence
    return sequences.select("chrom", F.posexplode(pieces).alias("chunk", "seq")).withColumn("chunk", F.col("chunk").cast("long"))


def subsequences(regions: DataFrame, chunks: DataFrame, size: int, key: str) -> DataFrame:
    """Adds ``seq``: bases ``start`` to ``end`` (1-based, inclusive) from the :func:`chunked`
    sequences.  ``key`` tells regions apart; those with nothing in reach are dropped.

    A region meets only the chunks it touches, so no row carries a whole chromosome."""
    spans = regions.select(F.col(key).alias("_key"), "chrom", "start", "end").withColumn("chunk", F.explode(F.sequence(F.floor((F.col("start") - 1) / size), F.floor((F.col("end") - 1) / size))))
    first = F.greatest(F.col("start") - F.col("chunk") * size, F.lit(1))
    last = F.least(F.col("end") - F.col("chunk") * size, F.lit(size))
    pieces = spans.join(chunks, ["chrom", "chunk"]).select("_key", "chunk", F.substr("seq", first.cast("int"), (last - first + 1).cast("int")).alias("piece"))
    whole = pieces.groupBy("_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "piece"))), lambda x: x["piece"]), "").alias("seq"))
    return regions.join(whole, F.col(key) == F.col("_key")).drop("_key")


def translate_chromosomes(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``chrom`` by its name in ``table`` (chrom, name); one that is absent is an error."""
    named = rows.join(table.select(F.col("chrom").alias("_c"), "name"), F.col("chrom") == F.col("_c"), "left")
    name = F.when(F.col("name").isNotNull(), F.col("name")).otherwise(F.raise_error(F.concat(F.lit("no translation of chromosome "), F.col("chrom"))))
    return named.withColumn("chrom", name.cast("string")).drop("_c", "name")
