"""Deduplication of lines over all documents, decided by bitmaps instead of text.

A line's key is the line without the blanks at both ends, A-Z lower-cased.  Keys of at least
``MIN_CHARS`` code points that are found in at least three documents lose all their lines but
those of the largest doc_id that holds them.

Only 128 bits of a key's hash, the document and the line's position are shuffled: they are
range-partitioned by hash, with a secondary sort by document (largest first) and position,
so a key's first occurrence in the stream tells the document that keeps it.  Ranges may cut a
key anywhere, thus a line that a third of all documents share is spread over many tasks; for
a key that begins a range the rows are left open and settled by two small sums over just
these keys, two for each range at most.  A task holds a batch and, of the current key, the
positions in its second document.

The result is one compressed bitmap for each document that loses lines; texts meet their
bitmaps by an equality join and are cut where they are.

Defined results: a null or empty text is one empty line; all rows without a doc_id are one
document, smaller than any other; rows that repeat a doc_id are one document with the
lines of all of them, and each row loses its own; if all lines go the text is empty; an
empty table gives an empty result; further columns pass through, those that are added
replace columns of the same name.  doc_id must be a whole number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from segspark.llm._scratch import discard, materialize

MIN_CHARS = 20
_SPACES = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a missing doc_id.
_NO_ID = -(1 << 63)
#: Rows of the stream: a line to drop, one of a key that began before its range, and
#: documents of a key that may go on in the next range.
DROP, OPEN, WITNESS = range(3)
_STREAMED = "kind int, h1 long, h2 long, doc long, print long, line int"


def _document() -> list[Column]:
    """Which document a row is of, and which of its rows."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("print")]


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``h1, h2, doc, print, line`` of each line whose key is long enough."""
    lines = docs.select(*_document(), F.posexplode(F.split("text", "\n", -1)).alias("line", "said"))
    key = F.translate(F.btrim("said", F.lit(_SPACES)), _UPPER, _LOWER)
    keyed = lines.select("doc", "print", "line", key.alias("key")).filter(F.char_length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "print", "line")


class _Stream:
    """Follows the sorted rows of a range; :meth:`rows` gives what a batch decides.

    Of the key that goes on in the next batch only its first three documents' first rows and
    the undecided rows of its second document are carried along."""

    def __init__(self) -> None:
        self.carried = [np.empty(0, np.int64)] * 4 + [np.empty(0, np.int32)]
        self.decided = np.empty(0, bool)
        self.first = True  # the current key began the range, so maybe before it

    def rows(self, *batch: np.ndarray) -> list[tuple]:
        rows = [np.concatenate(x) for x in zip(self.carried, batch)]
        decided = np.concatenate((self.decided, np.zeros(len(batch[0]), bool)))
        h1, h2, doc = rows[:3]
        new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        other = new | np.concatenate(([True], doc[1:] != doc[:-1]))
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(h1)))
        seen = np.cumsum(other)
        number = seen - np.repeat(seen[starts], size)  # of a row's document among its key's
        many = np.repeat(np.maximum.reduceat(number, starts) >= 2, size)
        early = np.zeros(len(h1), bool)
        early[: size[0]] = self.first
        drop = ((number >= 2) | ((number == 1) & many)) & ~early
        out = [(kind, *(x[of & ~decided] for x in rows)) for kind, of in ((OPEN, early), (DROP, drop))]
        self.first &= len(starts) == 1
        last = slice(starts[-1], None)
        waits = (number[last] == 1) & ~many[last] & (not self.first)
        carry = waits | (other[last] & (number[last] <= 2))
        self.carried, self.decided = [x[last][carry] for x in rows], ~waits[carry]
        return out

    def end(self) -> list[tuple]:
        """The last key may go on in the next range."""
        if self.first:
            return []
        return [(WITNESS, *self.carried), (OPEN, *(x[~self.decided] for x in self.carried))]


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stream = _Stream()

    def made(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        for kind, *columns in parts:
            if n := len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *map(pa.array, columns)], names=["kind", "h1", "h2", "doc", "print", "line"])

    for batch in batches:
        if len(batch):
            yield from made(stream.rows(*(batch.column(i).to_numpy() for i in range(5))))
    yield from made(stream.end())


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc, print, line`` of every line that goes."""
    lines = materialize(line_hashes(docs, min_chars), "lines")
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("print"), F.col("line")]
    sorted_lines = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    told = materialize(sorted_lines.mapInArrow(_first_occurrences, _STREAMED), "occurrences")
    discard(lines)
    # Keys that begin or end a range: common if a document lies between their ends.
    cut = told.filter(F.col("kind") != DROP)
    ends = F.broadcast(cut.groupBy("h1", "h2").agg(F.max("doc").alias("best"), F.min("doc").alias("least")))
    between = F.max((F.col("doc") > F.col("least")) & (F.col("doc") < F.col("best"))).alias("between")
    common = cut.join(ends, ["h1", "h2"]).groupBy("h1", "h2").agg(F.max("best").alias("best"), between).filter("between")
    late = cut.filter(F.col("kind") == OPEN).join(F.broadcast(common), ["h1", "h2"]).filter("doc < best")
    return told.filter(F.col("kind") == DROP).select("doc", "print", "line").unionByName(late.select("doc", "print", "line"))


def keep_bitmap(lines: list[int] | np.ndarray) -> bytes:
    """A bit for each line up to the last that goes, 0 where it goes, packed and compressed;
    all lines behind stay."""
    keep = np.ones(int(max(lines)) + 1, bool)
    keep[lines] = False
    return zlib.compress(np.packbits(keep).tobytes() + bytes([len(keep) % 8]))


def kept_lines(bitmap: bytes | None, n: int) -> np.ndarray:
    """Which of ``n`` lines stay."""
    keep = np.ones(n, bool)
    if bitmap is not None:
        raw = zlib.decompress(bitmap)
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, len(raw) - 1))
        size = len(bits) - (8 - raw[-1]) % 8
        keep[:size] = bits[:size]
    return keep


def line_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc, print, keep`` of the documents that lose lines; the others keep all."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([keep_bitmap(x.as_py()) for x in batch.column(2)], pa.binary())], names=["doc", "print", "keep"])

    # What meets here is one document's own lines.
    gone = dropped_lines(docs, min_chars).groupBy("doc", "print").agg(F.collect_list("line").alias("gone"))
    return gone.mapInArrow(pack, "doc long, print long, keep binary")


def keep_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the text that is left, and ``n_lines`` (before) and ``n_dropped``."""
    made = ("n_lines", "n_dropped")
    own = [f for f in docs.schema.fields if f.name not in (*made, "text")]
    schema = StructType([*own, docs.schema["text"], *(StructField(m, LongType()) for m in made)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, n_lines, n_dropped = [], [], []
            for x, keep in zip(batch.column(len(own)), batch.column(len(own) + 1)):
                body, bitmap = x.as_py(), keep.as_py()
                n, gone = (body or "").count("\n") + 1, 0
                if bitmap is not None:
                    stays = kept_lines(bitmap, n)
                    gone = n - int(stays.sum())
                    body = "\n".join(line for line, stay in zip(body.split("\n"), stays.tolist()) if stay)
                text.append(body)
                n_lines.append(n)
                n_dropped.append(gone)
            columns = [*batch.columns[: len(own)], pa.array(text, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    there = docs.select(*(F.col(f"`{f.name}`").alias(f"own_{f.name}") for f in own), F.col("text").alias("own_text"), *_document())
    joined = there.join(bitmaps, ["doc", "print"], "left")
    return joined.select(*(F.col(f"`own_{f.name}`") for f in own), "own_text", "keep").mapInArrow(cut, schema)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without the lines that go, with ``n_lines`` and ``n_dropped``."""
    return keep_lines(docs, materialize(line_bitmaps(docs, min_chars), "line-bitmaps"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP12_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(CAST(doc_id AS HUGEINT), CAST(-9223372036854775808 AS HUGEINT)) AS doc, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT row, doc, unnest(range(1, len(lines) + 1)) AS at_line, unnest(lines) AS line FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), common AS (
  SELECT key, max(doc) AS best FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc) >= 3
), kept AS (
  SELECT row, count(*) AS n_lines, count(*) FILTER (doc < best) AS n_dropped, string_agg(line, chr(10) ORDER BY at_line) FILTER (best IS NULL OR doc = best) AS body
  FROM k LEFT JOIN common USING (key) GROUP BY row
)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(body, '')) AS kept_sha256 FROM d JOIN kept USING (row)
"""
