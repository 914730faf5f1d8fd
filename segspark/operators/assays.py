"""Rows that sequencing software reads to tell barcoded assays apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Barcodes of one run.
MOST_BARCODES = 1000


def parse_barcodes(text: str) -> list[tuple[str, str]]:
    """(code, sample) pairs of a comma list; white space doesn't count."""
    parts = "".join(text.split()).split(",") if text.strip() else []
    if len(parts) % 2:
        raise ValueError("barcodes come as code,sample pairs")
    return list(zip(parts[::2], parts[1::2]))


def barcode_rows(assays: DataFrame, barcodes: DataFrame) -> DataFrame:
    """Six rows for each barcode (code, sample) and assay (id, primer_left, primer_right): in both
    groups the left primer, the right primer and the barcode, primers swapped in group 2.

    Barcodes are the few of one run, at most ``MOST_BARCODES``; more are an error.  They are
    collected and go into each assay's row as a literal array."""
    codes = barcodes.select("code", "sample").limit(MOST_BARCODES + 1).collect()
    if len(codes) > MOST_BARCODES:
        raise ValueError(f"more than {MOST_BARCODES} barcodes in one run")
    text = lambda x: F.lit(x).cast("string")
    listed = F.array(*(F.struct(text(c).alias("code"), text(s).alias("sample")) for c, s in codes)) if codes else F.array().cast("array<struct<code:string,sample:string>>")
    row = lambda kind, code, primer, group: F.struct(F.lit(kind).alias("kind"), code.alias("code"), primer.alias("primer"), F.lit("5prime").alias("place"), F.lit(group).alias("grp"))
    star, code, left, right = F.lit("*"), F.col("code"), F.col("primer_left"), F.col("primer_right")
    six = F.array(row(1, star, left, 1), row(3, star, right, 1), row(2, code, star, 1), row(1, star, right, 2), row(3, star, left, 2), row(2, code, star, 2))
    pairs = assays.select("id", "primer_left", "primer_right", F.explode(listed).alias("b")).select("id", "primer_left", "primer_right", "b.*")
    return pairs.select("id", "sample", F.explode(six).alias("r")).select("r.*", F.concat_ws("_", "sample", "id").alias("name"))
