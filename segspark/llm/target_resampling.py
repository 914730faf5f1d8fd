"""Resampling of documents towards a target by importance weights of hashed n-grams.

Features are the words of a text and its pairs of neighbouring words.  Each lies in one of
``BUCKETS`` buckets by the crc32 of its bytes; a bucket's gain is the floored thousandfold
log ratio of its smoothed shares in target and corpus.  A document's weight is the floored
mean of the gains of its features, its score adds Gumbel noise drawn from its id, so the
highest scores are a sample without replacement in proportion to exp(weight).

Words become integers by a dictionary of the texts that a task holds together (Arrow's exact
dictionary encoding), n-grams become tuples of these ids, and of each distinct tuple the
bytes are hashed once, from the checksum of its first word on; counts are joined back by
the tuples' places.  The dictionary lives as long as some MB of text, so it never grows with
the corpus, and no word leaves its task: the shuffle carries at most ``BUCKETS`` counts from
each task, and the driver gets ``BUCKETS`` sums.  Texts are read twice, for the counts and for
the weights, which costs less than to store the buckets of all features.  Ranks come from
ranges of the scores and the counts of the ranges before.

Defined results: a null or empty text has no words, no features and weight 0; a null
doc_id draws the number of the empty id and stands last among ties; rows that repeat a doc_id draw
alike, ties then go to fewer features, then to the smaller weight; an empty target or
corpus has counts of 0; an empty table gives an empty result; further columns pass through,
columns that are added replace those of the same name.  Very long texts are cut at
separators, with the last word carried over; only a single word must fit in a task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from segspark.llm._scratch import materialize, text_slices
from segspark.llm._sql import CRC_TABLE, crc32, utf8_bytes
from segspark.llm._words import NON_ALNUM
from segspark.llm.mixing import sums_before

BUCKETS = 10_000
#: Documents with fewer words are never drawn; of the others this many of a hundred are.
MIN_WORDS, PERCENT = 20, 25
SEED = 7
#: Bytes of text that share a dictionary.
SLICE = 2 << 20
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[0x41:0x5B] += 0x20


def stretches(column: pa.Array, max_bytes: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """Runs of whole rows as :func:`text_slices` gives them, but longer rows are cut at
    separators.  The last item tells that the data begin with the word before the cut."""
    for lo, hi, data, offsets in text_slices(column, max_bytes):
        if len(data) <= max_bytes:
            yield lo, hi, data, offsets, False
            continue
        at, led, size = 0, False, max_bytes
        while at < len(data):
            end = at + size
            while end < len(data) and not NON_ALNUM[data[end]]:
                ahead = np.flatnonzero(NON_ALNUM[data[end : end + size]])
                end = end + int(ahead[0]) if len(ahead) else end + size
            end = min(end, len(data))
            yield lo, hi, data[at:end], np.array([0, end - at]), led
            if end == len(data):
                break
            inside = np.flatnonzero(~NON_ALNUM[data[at:end]])
            if not len(inside):
                at = end
                continue
            before = np.flatnonzero(NON_ALNUM[data[at : at + inside[-1]]])
            at, led = at + (int(before[-1]) + 1 if len(before) else 0), True
            if end - at >= size:  # the word and what follows it are as long: go on behind them
                size = 2 * (end - at)


class Tuples:
    """The words and word pairs of consecutive texts as ids: ``word`` (id of each word),
    ``text`` (its row), ``pair`` (place of each pair among the distinct ones), ``pair_text``,
    and the bucket of each id and of each distinct pair."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, led: bool, buckets: int):
        inside = ~NON_ALNUM[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        begin[edges] = inside[edges]
        starts = np.flatnonzero(begin)
        bounds = np.append(np.cumsum(inside)[starts] - 1, inside.sum()).astype(np.int32)
        letters = _LOWERED[data[inside]]
        spelled = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
        ids = spelled.indices.to_numpy()
        text = np.searchsorted(offsets, starts, side="right") - 1
        words = spelled.dictionary.to_pylist()
        single = [zlib.crc32(w) for w in words]
        head = [zlib.crc32(b" ", c) for c in single]
        together = text[1:] == text[:-1]
        distinct, self.pair = np.unique((ids[:-1].astype(np.int64) << 32 | ids[1:])[together], return_inverse=True)
        double = [zlib.crc32(words[b], head[a]) for a, b in zip((distinct >> 32).tolist(), (distinct & 0xFFFFFFFF).tolist())]
        self.pair_text = text[1:][together]
        self.word, self.text = ids[int(led) :], text[int(led) :]  # a word before a cut is counted there
        self.word_bucket = np.array(single, np.int64) % buckets
        self.pair_bucket = np.array(double, np.int64) % buckets

    def counts(self, buckets: int) -> np.ndarray:
        """Features in each bucket."""
        found = np.zeros(buckets, np.int64)
        for at, bucket in ((self.word, self.word_bucket), (self.pair, self.pair_bucket)):
            np.add.at(found, bucket, np.bincount(at, minlength=len(bucket)))
        return found

    def sums(self, gains: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, features and the sum of gains of each text."""
        words = np.bincount(self.text, minlength=texts)
        # Gains are whole numbers: their sums in doubles are exact.
        total = np.bincount(self.text, gains[self.word_bucket][self.word], texts) + np.bincount(self.pair_text, gains[self.pair_bucket][self.pair], texts)
        return words, words + np.bincount(self.pair_text, minlength=texts), total.astype(np.int64)


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all ``texts`` in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets, led in stretches(batch.column(0)):
                found += Tuples(data, offsets, led, buckets).counts(buckets)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["bucket", "n"])

    sums = texts.select(F.col(f"`{text}`")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in sums.collect():  # at most ``buckets`` rows
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket from its counts, in doubles."""
    n, whole, aimed = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (whole + n) / ((s + 1) * (aimed + n)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with ``n_words, n_features, weight``, with or without the text itself."""
    made = ("n_words", "n_features", "weight")
    own = [f for f in docs.schema.fields if f.name not in made and (keep_text or f.name != text)]
    schema = StructType([*own, *(StructField(m, LongType()) for m in made)])
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch.column(len(own))
            words, features, total = (np.zeros(len(body), np.int64) for _ in range(3))
            for lo, hi, data, offsets, led in stretches(body):
                for out, found in zip((words, features, total), Tuples(data, offsets, led, len(shared.value)).sums(shared.value, hi - lo)):
                    out[lo:hi] += found
            columns = [*batch.columns[: len(own)], pa.array(words), pa.array(features), pa.array(total // np.maximum(features, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return docs.select(*(F.col(f"`{f.name}`") for f in own), F.col(f"`{text}`").alias("_body")).mapInArrow(run, schema)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """The Gumbel number of an id, a thousandfold and floored."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED, keep_text: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``n_words, n_features, weight, score, rank``; rank is
    null unless the document is drawn.  ``target`` holds texts like those that are wanted."""
    gains = bucket_gains(bucket_counts(docs, buckets=buckets), bucket_counts(target, buckets=buckets))
    weighed = weigh(docs.drop("score", "rank"), gains, keep_text=keep_text)
    scored = materialize(weighed.withColumn("score", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long")), "scores")
    long_enough = F.col("n_words") >= min_words
    drawn = scored.filter(long_enough).count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    ranked = sums_before(scored.filter(long_enough), order, {"_before": F.lit(1).cast("long")})
    rank = F.when(F.col("_before") < drawn, F.col("_before") + 1).alias("rank")
    return ranked.select(*scored.columns, rank).unionByName(scored.filter(~long_enough).withColumn("rank", F.lit(None).cast("long")))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


#: Features are plain strings here, hashed byte by byte.
OP13_SQL = rf"""
WITH crc AS ({CRC_TABLE}), w AS (
  SELECT row, kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM (SELECT row_number() OVER () AS row, 'd' AS kind, doc_id, text FROM documents UNION ALL SELECT row_number() OVER (), 'b', NULL, text FROM benchmark)
), f AS (
  SELECT kind, row, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS feature FROM w
), n AS (
  SELECT kind, row, feature, count(*) AS n FROM f GROUP BY ALL
), h AS (
  SELECT feature, {crc32(utf8_bytes("feature"))} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM n), crc
), c AS (
  SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0) AS s, coalesce(sum(n) FILTER (kind = 'b'), 0) AS t FROM n JOIN h USING (feature) GROUP BY bucket
), a AS (
  SELECT sum(s) AS s_all, sum(t) AS t_all FROM c
), g AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS BIGINT) AS gain FROM c, a
), m AS (
  SELECT row, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE) AS BIGINT) AS weight FROM n JOIN h USING (feature) JOIN g USING (bucket) WHERE kind = 'd' GROUP BY row
), r AS (
  SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM w LEFT JOIN m USING (row) WHERE kind = 'd'
), z AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296::DOUBLE))) AS BIGINT) AS score FROM r
), o AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) FILTER (n_words >= 20) OVER () AS enough FROM z
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * enough // 100 THEN place END AS rank FROM o
"""
