"""Importance resampling against a plain version and SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import segspark.llm.target_resampling as tr

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = WORD.findall((text or "").translate(UPPER))
    return words, [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def plain(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    whole, aimed, rows = sum(s.values()), sum(t.values()), []
    for i, text in docs:
        words, found = features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (whole + 10_000) / ((s[b] + 1) * (aimed + 10_000)))) for b in found]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    order = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(order[: 25 * len(order) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in rows]


def odd_rows():
    dice = random.Random(2)
    vocabulary = [dice.choice(["Alpha", "beta7", "GAMMA", "dÉlta", "ß", "x_y", "a-b", "日本", "42"]) + str(i % 50) for i in range(200)]
    rows = [(i, " ".join(dice.choices(vocabulary, k=dice.randint(0, 60)))) for i in range(150)]
    return rows + rows[:9] + [(3, "another text " * 15), (None, "no id at all " * 9), (None, None), (200, ""), (201, " \x00\x01..."), (202, "w" * 3_000), (203, " ".join(dice.choices(vocabulary, k=60_000)))]


TARGET = ["beta7 beta7 GAMMA3 alpha4 alpha5", None, "", "Beta71 is the dÉlta3 of 42"]


def test_against_plain_version_and_sql(spark, tmp_path):
    rows = odd_rows()
    schema = "doc_id long, text string, weight string, rank int, n_words int, bucket int, _before int"
    spark.createDataFrame([(*r, "w", 1, 2, 3, 4) for r in rows], schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = tr.op13_target_resampling(spark, str(tmp_path))
    found = sorted(map(tuple, df.collect()), key=repr)
    assert found == sorted(plain(rows, TARGET), key=repr)
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    assert sorted(con.execute(tr.OP13_SQL).fetchall(), key=repr) == found


def test_general_interface(spark, odd_docs, no_docs):
    target = spark.createDataFrame([("a b c d",)], "text string")
    out = tr.resample(odd_docs, target, percent=50, min_words=1, keep_text=True)
    made = {"n_words", "n_features", "weight", "score", "rank"}
    assert set(out.columns) == {*odd_docs.columns} | made
    assert out.count() == odd_docs.count()
    ranks = sorted(r["rank"] for r in out.collect() if r["rank"] is not None)
    assert ranks == list(range(1, out.filter("n_words >= 1").count() // 2 + 1))
    assert tr.resample(no_docs, target).count() == 0
    assert tr.resample(odd_docs, no_docs).count() == odd_docs.count()


@pytest.mark.parametrize("size", [1, 2, 5, 17, 100, 1 << 20])
def test_cut_texts_count_alike(size):
    texts = [t for _, t in odd_rows()[:40]] + [None, "", "...", "one", "x" * 300, "aa bb " * 50, " " * 200, "é" * 99 + " é"]
    gains = np.arange(tr.BUCKETS) - 5000
    words, total, n = (np.zeros(len(texts), np.int64) for _ in range(3))
    counts = np.zeros(tr.BUCKETS, np.int64)
    for lo, hi, data, offsets, led in tr.stretches(pa.array(texts, pa.string()), size):
        piece = tr.Tuples(data, offsets, led, tr.BUCKETS)
        counts += piece.counts(tr.BUCKETS)
        for out, found in zip((words, n, total), piece.sums(gains, hi - lo)):
            out[lo:hi] += found
    expected = [features(t) for t in texts]
    assert words.tolist() == [len(w) for w, _ in expected]
    assert n.tolist() == [len(f) for _, f in expected]
    assert total.tolist() == [sum(int(gains[b]) for b in f) for _, f in expected]
    assert counts.tolist() == np.bincount([b for _, f in expected for b in f], minlength=tr.BUCKETS).tolist()
