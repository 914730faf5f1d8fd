"""WARC archives: write with an index, read back by coalesced byte ranges.

Writing streams each partition into one archive in the shared folder and returns an index
row per record: file, offset, length, address, digest.  A task attempt writes a file of
its own name, and only the rows of attempts that succeed reach the index, so a repeated
or lost attempt leaves at most a file that nothing refers to.  Reading starts from the
index alone: the selected records of a file are sorted by offset, neighbours are joined
to ranges of at most ``range_bytes`` (gaps up to ``gap_bytes`` are read over), and each
range is one read, whichever tasks the ranges go to.

Of records with equal payloads of at least ``min_bytes`` the one with the largest page_id
is the response and the others revisit it.  Equal means equal SHA-1.

Defined results: a null html is an empty payload; a null url is written as an empty
WARC-Target-URI; rows that repeat a page_id with the same payload are all responses
if they are the largest; a null page_id cannot be referred to and is a revisit wherever
another page holds the same payload; very long payloads are one record; an empty table
gives an empty index; further columns don't enter the archive.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segspark.llm._scratch import materialize, scratch_path

#: Payloads smaller than this are never revisits.
MIN_BYTES = 1000
#: One read covers at most so many bytes, unless a single record is longer.
RANGE_BYTES = 1 << 20
#: Unselected bytes between two selected records that are read over rather than skipped.
GAP_BYTES = 64 << 10
#: So many digests that repeat are broadcast.  Where there are more, hot ones are: those with
#: more pages than HOT_PAGES and than a HOT-th of all (so HOT at most), and the buckets, at
#: most BUCKETS, that the others fall in.
DIRECT, HOT_PAGES, HOT, BUCKETS = 1 << 16, 1024, 1 << 16, 1 << 18
INDEX = "page_id long, file string, offset long, length long, url string, payload_digest string, payload_bytes long"


def revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``page_id, url, html, digest, refers_to`` (null: a response).

    Only digests and ids are aggregated.  Pages meet what repeats by broadcast; where too
    many digests repeat for that, html moves only where one does, and no group of pages
    that moves is larger than that of a digest that isn't hot."""
    body = F.coalesce("html", F.lit(""))
    digested = pages.select("page_id", "url", body.alias("html"), F.sha1(body.cast("binary")).alias("digest"))
    large = F.octet_length("html") >= min_bytes
    shared = digested.filter(large).groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).filter("n > 1 AND best IS NOT NULL")
    shared = materialize(shared.select(F.col("digest").alias("_digest"), "best", "n"), "digests")
    refers = lambda best: F.when(~F.col("page_id").eqNullSafe(best) & best.isNotNull(), best).alias("refers_to")
    of = shared.agg(F.count("*").alias("digests"), F.sum("n").alias("pages")).first()
    many = max(HOT_PAGES, (of["pages"] or 0) // HOT) if of["digests"] > DIRECT else 0
    here = F.broadcast(shared.filter(F.col("n") > many).select(F.col("_digest").alias("_here"), F.col("best").alias("_best")))
    marked = digested.join(here, large & (F.col("digest") == F.col("_here")), "left")
    found = lambda df, best: df.select("page_id", "url", "html", "digest", refers(F.col(best)))
    if not many:
        return found(marked, "_best")
    others, bucket = shared.filter(F.col("n") <= many), lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
    buckets = F.broadcast(others.select(bucket("_digest").alias("_bucket")).distinct())
    marked = marked.join(buckets, large & (bucket("digest") == F.col("_bucket")), "left")
    settled = F.col("_here").isNotNull() | F.col("_bucket").isNull()
    looked_up = marked.filter(~settled).join(others, F.col("digest") == F.col("_digest"), "left")
    return found(marked.filter(settled), "_best").unionByName(found(looked_up, "best"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record with its closing blank lines."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    head += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The record that ``data`` holds: its fields and, for responses, the payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda key: int(x) if (x := fields.get(key, "").removeprefix("<urn:page:").removesuffix(">")) else None
    return {"page_id": number("WARC-Record-ID"), "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": size, "payload": payload if fields["WARC-Type"] == "response" else None}


def write_archive(pages: DataFrame, path: str | None = None, compress: bool = True, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives under ``path`` (a URI that all
    executors reach; the shared folder if none is given) and return the stored index."""
    path = path or scratch_path(pages.sparkSession, "archive")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        name, out, at = f"{uuid.uuid4().hex}.warc" + ".gz" * compress, None, 0
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("page_id", "file", "offset", "length", "url", "payload_digest", "payload_bytes")}
            for page, url, html, digest, refers in zip(*(c for c in batch.columns), strict=True):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                payload = html.as_py().encode()
                data = record(page.as_py(), url.as_py(), payload, digest.as_py(), refers.as_py())
                data = gzip.compress(data, 1, mtime=0) if compress else data
                out.write(data)
                for k, v in zip(rows, (page.as_py(), name, at, len(data), url.as_py(), digest.as_py(), len(payload)), strict=True):
                    rows[k].append(v)
                at += len(data)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([(k, pa.string() if k in ("file", "url", "payload_digest") else pa.int64()) for k in rows]))
        if out is not None:
            out.close()

    index = revisits(pages.select("page_id", "url", "html"), min_bytes).mapInArrow(write, INDEX)
    return materialize(index.withColumn("file", F.concat(F.lit(path + "/"), F.col("file"))), "archive-index")


def byte_ranges(selected: DataFrame, range_bytes: int = RANGE_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """Index rows coalesced to ``file, start, stop, records`` (offset, length of each).

    Stretches are cut where the next record lies more than ``gap_bytes`` on, or where a
    multiple of ``range_bytes`` is passed, so no group exceeds a range and a record."""
    slot = F.floor(F.col("offset") / range_bytes).alias("slot")
    in_slot = Window.partitionBy("file", "slot").orderBy("offset", "length")
    breaks = F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(in_slot) > gap_bytes
    cut = selected.select("file", "offset", "length", slot).withColumn("new", F.coalesce(breaks, F.lit(False)).cast("long"))
    grouped = cut.withColumn("range", F.sum("new").over(in_slot.rowsBetween(Window.unboundedPreceding, 0)))
    places = F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("records")
    return grouped.groupBy("file", "slot", "range").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), places).drop("slot", "range")


def read_records(selected: DataFrame, payload: bool = False, range_bytes: int = RANGE_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """The records that ``selected`` index rows point to, read back from the archives and
    checked: the payload of a response must have the digest and the length it states."""
    schema = "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long" + ", payload binary" * payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        kinds = {"page_id": pa.int64(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_digest": pa.string(), "payload_bytes": pa.int64()} | ({"payload": pa.binary()} if payload else {})
        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(row["file"])
                with store.open_input_file(path) as f:
                    data = f.read_at(row["stop"] - row["start"], row["start"])
                found = []
                for place in row["records"]:
                    at = place["offset"] - row["start"]
                    raw = data[at : at + place["length"]]
                    x = parse(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
                    if x["payload"] is not None and (len(x["payload"]), hashlib.sha1(x["payload"]).hexdigest()) != (x["payload_bytes"], x["payload_digest"]):
                        raise ValueError(f"page {x['page_id']}: the payload is not what its record states")
                    found.append(x)
                yield pa.RecordBatch.from_pydict({k: [x[k] for x in found] for k in kinds}, schema=pa.schema(list(kinds.items())))

    # The index is small but what it points to isn't: ranges are dealt to as many tasks as
    # a shuffle has, which adaptive execution would take for one small partition.
    tasks = int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return byte_ranges(selected, range_bytes, gap_bytes).repartition(tasks, "file", "start").mapInArrow(read, schema)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), b AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS best FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM b
"""
