"""Writers.  Rows become lines by one projection; headers stand in a file of their own
part, written first, so that rows stay distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tabbed(*columns: Column | str, missing: str = "NA") -> Column:
    """Columns as one tab-separated line."""
    return F.concat_ws("\t", *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(missing)) for c in columns))


def write_lines(rows: DataFrame, path: str, header: list[str] = (), force: bool = False) -> None:
    """A ``line`` column as text under ``path`` and the header under ``path``-header; what is
    there is overwritten only if ``force``."""
    mode = "overwrite" if force else "errorifexists"
    rows.select(F.col("line").alias("value")).write.mode(mode).text(path)
    if header:
        rows.sparkSession.createDataFrame([(x,) for x in header], "value string").coalesce(1).write.mode(mode).text(f"{path}-header")


def pooled_line(samples: list[str]) -> Column:
    """A row of the normalised table (see operators.normalise) as text."""
    segr = F.when(F.col("segr_major").isNotNull(), F.concat_ws(",", "segr_major", "segr_minor"))
    return tabbed("chrom", "pos", F.lit("."), "ref", F.array_join("alt", ","), "major", "minor", "qual", F.array_join("filter", ";"), "type", segr, "hapsc", F.array_join("format", ":"), *samples)


#: Fixed value: the first line of a normalised table.
FORMAT = "##fileformat=RCBIv0.1"


def pooled_header(samples: list[str], copied: list[str] = (), command: str | None = None) -> list[str]:
    first = [FORMAT, *copied, *([f"##commandline={command}"] if command else [])] if command or copied else []
    return [*first, "#" + "\t".join(["CHROM", "POS", "ID", "REF", "ALT", "MAJOR", "MINOR", "QUAL", "FILTER", "TYPE", "SEGR", "HAPSC", "FORMAT", *samples])]


def write_scores(scores: DataFrame, path: str, force: bool = False) -> None:
    """``chrom, pos, score`` as comma-separated files without a header, a folder for each chromosome."""
    scores.select("chrom", F.col("chrom").alias("name"), "pos", "score").write.mode("overwrite" if force else "errorifexists").partitionBy("chrom").csv(path)


def assay_vcf_line() -> Column:
    """A minimal VCF row of an assay."""
    return tabbed("chrom", "pos", "id", "ref", "alt", F.lit("."), "filter", F.lit("."), missing=".")


def assay_vcf_header() -> list[str]:
    from datetime import date

    return ["##fileformat=VCFv4.1", f"##fileDate={date.today():%Y%m%d}", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]


def primer_line() -> Column:
    from segspark.sources.text import PRIMER_COLUMNS

    return tabbed(*PRIMER_COLUMNS, missing=".")
