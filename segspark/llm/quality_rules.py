"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a rejecting condition over the text and what is measured of it.  On a sample
of about ``sample_rows`` rows, drawn from the whole table, each rule is evaluated many
times over to learn its cost, and what it rejects is counted together with what the others
do.  The rules then stand in the order of rejections per cost, each counted on the rows
that those before it leave, inside one ``CASE`` whose branches are evaluated lazily: cheap
and selective rules spare the others.  The order changes only the work, never which
documents are kept.

Defined results: null and empty texts have no words, so they fail the base rule; very
long texts are measured whole; repeated rows give repeated results; an empty table gives
an empty result; further columns pass through untouched, and the columns that are added
replace columns of the same name.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.llm._scratch import discard, materialize

SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]"
WINDOW = 8
#: Rows that costs and selectivities are estimated on, about; how often each is evaluated.
SAMPLE_ROWS, REPEATS = 1000, 20


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def _matched(text: Column, pattern: str) -> Column:
    """Matches of a pattern that few places match."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def _outside(text: Column, runs: str) -> Column:
    """Characters that no run of ``runs`` covers."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), runs, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return _matched(text, "[#*$%&|<>]")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))
    return _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside ``window``-word windows that occur twice or more in the text."""

    def hashes(w: Column) -> Column:
        """Words are hashed once; a window is the hash of their hashes."""

        def windows(h: Column) -> Column:
            first = F.slice(h, F.lit(1), F.size(h) - F.lit(window - 1))
            return F.transform(first, lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, window))))

        many = _let(F.transform(w, lambda x: F.xxhash64(x)), windows)
        return F.when(F.size(w) > window, many).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda p, j, s: F.coalesce(F.get(p, j)["h"] == s["h"], F.lit(False))
        twice = _let(ordered, lambda p: F.filter(p, lambda s, j: same(p, j - 1, s) | same(p, j + 1, s)))
        places = F.array_sort(F.transform(twice, lambda s: s["i"]))
        step = lambda p, v, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - v, F.lit(window)))
        return _let(places, lambda p: F.aggregate(F.transform(p, lambda v, j: step(p, v, j)), F.lit(0), lambda a, x: a + x))

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)).cast("long")

    return _let(_let(words, hashes), count)


def base_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``
    and ``base_failed`` of each row, beside its own columns."""
    made = ["_words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    own = [c for c in docs.columns if c not in made]
    kept = [F.col(f"`{c}`") for c in own]
    body, w = F.col(f"`{text}`"), F.col("_words")
    return (
        docs.select(*kept, words_of(body).alias("_words"))
        .select(
            *kept,
            F.size(w).cast("long").alias("n_words"),
            word_chars(w).alias("word_chars"),
            n_symbols(body).alias("n_symbols"),
            n_dup_lines(body).alias("n_dup_lines"),
            n_repeat_words(w).alias("n_repeat_words"),
        )
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    )


class Measures:
    """What rules are made of: the text, and measures of it by name.

    A measure is the column of that name if the table has it (``of``: see
    :func:`base_measures`), else made from the text."""

    def __init__(self, text: Column, of: DataFrame | None = None):
        self.text, self._have = text, set() if of is None else set(of.columns)

    def __getattr__(self, name: str) -> Column:
        if name in self._have:
            return F.col(name)
        words = lambda: words_of(self.text)
        made = {"n_words": lambda: F.size(words()).cast("long"), "word_chars": lambda: word_chars(words()), "n_symbols": lambda: n_symbols(self.text), "n_dup_lines": lambda: n_dup_lines(self.text)}
        if name not in made:
            raise AttributeError(name)
        return made[name]()


@dataclass(frozen=True)
class Rule:
    """``rejects`` makes the rejecting condition from the measures; it must be true or
    false, also for null and empty texts."""

    name: str
    rejects: Callable[[Measures], Column]


RULES = [
    Rule("short_words", lambda m: m.word_chars < 2 * m.n_words),
    Rule("long_words", lambda m: m.word_chars > 30 * m.n_words),
    Rule("symbols", lambda m: 10 * m.n_symbols > 4 * m.n_words),
    Rule("shouting", lambda m: 10 * _outside(m.text, "\\P{Lu}+") > 5 * F.greatest(_outside(m.text, "\\P{L}+"), F.lit(1))),
    Rule("repeated_lines", lambda m: 2 * m.n_dup_lines > _matched(m.text, "\n") + 1),
    Rule("no_letters", lambda m: ~F.coalesce(m.text, F.lit("")).rlike("\\p{L}")),
]


def rule_costs(measured: DataFrame, rules: list[Rule], text: str = "text", repeats: int = REPEATS) -> list[float]:
    """Seconds that each rule takes on ``measured``: the time of ``repeats`` evaluations of
    every row over that of as many rows alone, but at least a thousandth of the latter."""
    again = measured.withColumn("_time", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    m = Measures(F.col(f"`{text}`"), measured)

    def seconds(condition: Column) -> float:
        job = again.agg(F.count_if(condition))
        began = time.perf_counter()
        job.collect()  # one row
        return time.perf_counter() - began

    seconds(F.col("_time") < 0)  # warm up
    bare = min(seconds(F.col("_time") < 0) for _ in range(2))
    return [max(seconds(rule.rejects(m)) - bare, bare / 1000) / repeats for rule in rules]


def best_order(patterns: list[tuple[tuple[bool, ...], int]], costs: list[float]) -> list[int]:
    """Rules (by number) by rejections per cost, each counted on what is left by those
    before it; ``patterns``: which rules reject, and how many rows.  Ties go by number."""
    order, rest = [], list(range(len(costs)))
    while rest:
        left = [(p, n) for p, n in patterns if not any(p[i] for i in order)]
        rate = {i: sum(n for p, n in left if p[i]) / costs[i] for i in rest}
        # Rules that reject nothing more go by cost.
        best = min(rest, key=lambda i: (-rate[i], costs[i], i))
        order.append(best)
        rest.remove(best)
    return order


def order_rules(docs: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS, rows: int | None = None) -> list[Rule]:
    """The rules, best first, as a sample of about ``sample_rows`` rows suggests.

    ``docs`` may hold measures already; those that it lacks are made.  Rows are drawn all
    over the table where they lie, so the sample needs no shuffle; ``rows`` says how many
    there are, if that is known."""
    rows = docs.count() if rows is None else rows
    sample = docs.sample(fraction=min(1.0, sample_rows / max(rows, 1)), seed=11) if rows > sample_rows else docs
    measured = materialize(base_measures(sample.select(F.col(f"`{text}`").alias("text"))), "rule-sample")
    m = Measures(F.col("text"), measured)
    flags = [rule.rejects(m).alias(f"r{i}") for i, rule in enumerate(rules)]
    found = measured.select(*flags).groupBy(*(f"r{i}" for i in range(len(rules)))).count().collect()  # no more than the sample
    patterns = [(tuple(bool(x) for x in r[:-1]), r[-1]) for r in found]
    order = best_order(patterns, rule_costs(measured, rules))
    discard(measured)
    return [rules[i] for i in order]


def cascade(rules: list[Rule], text: Column, measures: Measures | None = None) -> Column:
    """Name of the first rule in this order that rejects the text, else null."""
    m = measures or Measures(text)
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.rejects(m), F.lit(rule.name)).otherwise(verdict)
    return verdict


def quality_rules(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with the base measures, ``rejected_by`` (null: kept) and ``kept``.

    ``rejected_by`` names one rejecting rule; which one it is, where several reject,
    depends on the measured order.  ``kept`` does not."""
    ordered = order_rules(docs, RULES if rules is None else rules, text, sample_rows)
    measured = base_measures(docs.drop("rejected_by", "kept") if text not in ("rejected_by", "kept") else docs, text)
    body = F.col(f"`{text}`")
    by = F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(ordered, body, Measures(body, measured)))
    return measured.withColumn("rejected_by", by).withColumn("kept", F.col("rejected_by").isNull())


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text,
         list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), win AS (
  SELECT rid, i, array_to_string(words[i:i+7], ' ') AS k
  FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
), places AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c >= 2
), steps AS (
  SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS s FROM places
), rep AS (
  SELECT rid, CAST(sum(s) AS BIGINT) AS n_repeat_words FROM steps GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, text, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(regexp_extract_all(text, '\p{Lu}')) AS upper_n, len(regexp_extract_all(text, '\p{L}')) AS letter_n,
         len(regexp_extract_all(text, '\n')) AS line_ends
  FROM w LEFT JOIN rep USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words
            OR word_chars < 2 * n_words OR word_chars > 30 * n_words
            OR 10 * n_symbols > 4 * n_words
            OR 10 * upper_n > 5 * greatest(letter_n, 1)
            OR 2 * n_dup_lines > line_ends + 1 OR letter_n = 0) AS kept
FROM m
"""
