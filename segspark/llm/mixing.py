"""Mixing sources to target weights, in DataFrame functions only.

Sizes (words) are summed per source; sources in code-point order (null last) get the
weights 3, 1, 2, repeating, and share ``budget`` times all words.  A source stops at
``cap`` times its size and what it cannot take is shared again by weight.  With
``rate = target / source_size`` a document is taken ``floor(rate)`` times, and once more
if a number drawn from the hash of its id, its text and the seed is below the fraction.

Defined results: a null or empty text has size 0; a null source is a source of its own;
a source of size 0 has target 0 and none of its documents is taken; rows equal in doc_id
and text draw alike, rows without a doc_id draw by their text; an empty table gives an empty
result; further columns pass through, the columns that are added replace those of the
same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segspark.llm._scratch import materialize

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
CAP = 2
SEED = "mix-0"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def uniform(key: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) from the md5 of id, text and seed: alike on every run and engine."""
    name = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def sums_before(table: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``table`` with sums over all rows that stand before in ``order``, without a global
    window: ranges of rows are summed on their own and shifted by those before them."""
    ranges = materialize(table.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    whole = ranges.groupBy("_range").agg(*(F.sum(c).alias(f"_{name}") for name, c in sums.items()))
    # One row for each range, at most the shuffle partitions.
    above = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = whole.select("_range", *(F.coalesce(F.sum(f"_{name}").over(above), F.lit(0)).alias(f"_{name}") for name in sums))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = ranges.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(name) for name, c in sums.items()))
    return here.join(shift, "_range").select(*(c for c in table.columns), *((F.col(name) + F.col(f"_{name}")).alias(name) for name in sums))


def ranked(sources: DataFrame, column: str) -> DataFrame:
    """``sources`` with their 0-based ``rank`` by ``column``, nulls last."""
    return sums_before(sources, [F.col(column).asc_nulls_last()], {"rank": F.lit(1).cast("long")})


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """``source, source_size, target`` of rows with ``source`` and ``size``.

    Targets are ``min(cap, w * level)``.  Sources reach their caps in the order of cap / w, so
    the level is where the first source stands that doesn't reach its own, given that all
    before it do: two sums over the sources before, however many there are."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    table = materialize(ranked(sums, "source").select("source", "source_size", weight.alias("w"), (cap * F.col("source_size")).cast("double").alias("cap")), "sources")
    whole = table.agg(F.sum("source_size").alias("n"), F.sum("w").alias("w")).first()
    ratio = F.col("cap") / F.col("w")
    in_turn = sums_before(table, [ratio, F.col("source").asc_nulls_last()], {"caps": F.col("cap"), "ws": F.col("w")})
    level = (F.lit(budget * (whole["n"] or 0)) - F.col("caps")) / (F.lit(whole["w"] or 1.0) - F.col("ws"))
    free = in_turn.select(level.alias("level"), ratio.alias("ratio")).filter("level <= ratio").agg(F.min_by("level", "ratio").alias("level")).first()["level"]
    filled = F.col("w") * F.lit(free) if free is not None else F.lit(float("inf"))
    return table.select("source", "source_size", F.least(F.col("cap"), filled).alias("target"))


def draw(sized: DataFrame, targets: DataFrame, u: Column) -> DataFrame:
    """``sized`` with ``source_size, target, copies, taken``; ``u`` is each row's number in [0, 1)."""
    mine = targets.select(F.col("source").alias("_source"), "source_size", "target")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    whole = F.floor(F.col("_rate"))
    return (
        sized.drop("source_size", "target", "copies", "taken")
        .join(mine, F.col("source").eqNullSafe(F.col("_source")), "left")
        .withColumn("_rate", rate)
        .withColumn("_u", u)
        .withColumn("copies", whole + F.when(F.col("_u") < F.col("_rate") - whole, 1).otherwise(0))
        .withColumn("taken", F.col("size") * F.col("copies"))
        .drop("_source", "_rate", "_u")
    )


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with ``size, source_size, target, copies,
    taken``.  Only ids, sources and sizes are aggregated; texts stay where they are."""
    sized = docs.withColumn("size", word_count(F.col("text")))
    return draw(sized, source_targets(sized, weights, budget, cap), uniform(F.col("doc_id"), F.col("text"), seed))


def emit_copies(mixed: DataFrame) -> DataFrame:
    """Each document ``copies`` times, numbered from 1 in ``copy``."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    u = uniform(F.col("doc_id"), F.col("text"), SEED).alias("u")
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), u), "sizes")
    return draw(sized, source_targets(sized), F.col("u")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) || ':mix-0'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(2 * sum(size) AS DOUBLE) AS cap,
         CAST([3, 1, 2][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, coalesce(sum(cap) OVER before, 0) AS caps, (SELECT sum(w) FROM s) - coalesce(sum(w) OVER before, 0) AS ws,
         1.5 * (SELECT sum(source_size) FROM s)::DOUBLE AS total, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k
  FROM s WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT coalesce(arg_min((total - caps) / ws, k) FILTER (WHERE w * ((total - caps) / ws) <= cap), 0) AS level FROM o
), t AS (
  SELECT source, source_size, least(cap, w * level) AS target FROM s, l
), r AS (
  SELECT doc_id, size, source_size, target, coalesce(target / nullif(source_size, 0), 0) AS rate, u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       size * CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM r
"""
