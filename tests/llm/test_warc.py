import hashlib

import pytest
from pyspark.sql import functions as F

from segspark.llm import warc as A

BIG = "<html>" + "ü" * 600
PAGES = [(1, "http://a/", BIG), (2, "http://b/", BIG), (3, None, None), (4, "http://c/\r\nX: y", "tiny"), (5, "u", "tiny"), (6, "u", "x\r\n\r\nWARC/1.1\r\n" * 200), (7, "u", "L" * 3_000_000), (None, "u", BIG), (2, "http://b/", BIG), (8, "u", "\x00\r\n")]


def want(rows):
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if p is not None and (h or "").encode() == body]
        best = max(same, default=None) if len(body) >= 1000 else page
        revisit = best is not None and best != page
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", best if revisit else None))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, 1) for r in PAGES], "page_id long, url string, html string, offset int").repartition(3)
    for compress in (True, False):
        index = A.write_archive(pages, compress=compress)
        for ranges, gap in ((4 << 20, 64 << 10), (1, 0), (1000, 10)):
            assert found(A.read_records(index, range_bytes=ranges, gap_bytes=gap)) == want(PAGES)
    payloads = {r["page_id"]: r["payload"] for r in A.read_records(index, payload=True).collect()}
    assert bytes(payloads[7]) == b"L" * 3_000_000 and payloads[1] is None and bytes(payloads[6]).decode() == PAGES[5][2]


def test_selected_records_only(spark):
    index = A.write_archive(spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1))
    some = index.filter(F.col("page_id").isin(1, 5, 8))
    assert found(A.read_records(some)) == [r for r in want(PAGES) if r[0] in (1, 5, 8)]
    assert A.byte_ranges(some, gap_bytes=0).count() == 3 and A.byte_ranges(index, range_bytes=1 << 40, gap_bytes=1 << 30).count() == 1


def test_no_pages(spark):
    index = A.write_archive(spark.createDataFrame([], "page_id long, url string, html string"))
    assert A.read_records(index).count() == 0


@pytest.mark.parametrize("direct", [0, 1 << 16])
def test_hot_digests_and_many_small_pages(spark, monkeypatch, direct):
    monkeypatch.setattr(A, "HOT_PAGES", 5)
    monkeypatch.setattr(A, "DIRECT", direct)
    rows = [(i, "u", ["small", BIG, BIG + "x", BIG + str(i // 3)][i % 4]) for i in range(400)] + [(1000 + i, "u", None) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    index = A.write_archive(pages)
    assert found(A.read_records(index)) == want(rows)
    parts = A.revisits(pages.filter("html IS NULL OR html = 'small'"))
    assert parts.filter("refers_to IS NOT NULL").count() == 0 and parts.count() == 300
