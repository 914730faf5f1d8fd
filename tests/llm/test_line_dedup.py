"""Line dedup against SQL, with keys cut by batches and ranges, and its bitmaps."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import segspark.llm.line_dedup as ld

SCHEMA = "doc_id long, text string, keep int, n_lines string, line int, h1 int"


def odd_rows():
    dice = random.Random(3)
    common = [f"A line that many share, no {i}" for i in range(12)] + ["just twenty chars !!", "nineteen characters", "Ünïcödé lines of 20!", "ÜNÏCÖDÉ LINES of 20!", ""]
    blanks = ["", " ", "\t", "\x0b ", "\r"]
    rows = []
    for i in range(120):
        lines = [dice.choice(blanks) + dice.choice((str.upper, str.lower, str))(dice.choice(common)) + dice.choice(blanks) if dice.random() < 0.6 else f"a line of its own {i} {j} in here" for j in range(dice.randint(0, 12))]
        rows.append((dice.randint(0, 70), "\n".join(lines)))
    # A line of a third of all rows, often more than once in a document, and rows that repeat.
    rows += [(1000 + i, "the very same boiler plate line\nown line number %d of this\n" % i + "The very same boiler plate line \n" * (i % 4)) for i in range(200)]
    rows += [(None, "the very same boiler plate line\nA line that many share, no 1"), (None, None), (5, None), (6, ""), (-(1 << 62), "the very same boiler plate line"), (7, "x" * 300_000 + "\n" + "y" * 30)]
    return [(*r, 1, "n", 2, 3) for r in rows + rows[:9]]


@pytest.mark.parametrize("batch, ranges", [(10_000, 1), (3, 1), (5, 40), (1, 7), (10_000, 150)])
def test_same_rows_as_sql(spark, tmp_path, batch, ranges):
    spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    expected = sorted(con.execute(ld.OP12_SQL).fetchall(), key=repr)
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(before, (batch, ranges, "false")):
            spark.conf.set(k, v)
        found = ld.op12_line_dedup(spark, str(tmp_path))
        assert found.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
        assert sorted(map(tuple, found.collect()), key=repr) == expected
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_general_interface(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    out = ld.dedup_lines(docs, min_chars=5)
    assert sorted(out.columns) == sorted({*docs.columns, "n_lines", "n_dropped"})
    assert out.count() == docs.count()
    assert out.filter(F.col("text").contains("own line number")).count() == 200
    assert out.filter("doc_id = 6 AND text = ''").select("n_lines", "n_dropped").distinct().collect() == [(1, 0)]


def test_empty_table(spark, no_docs):
    assert ld.dedup_lines(no_docs).count() == 0


def test_bitmaps():
    dice = np.random.default_rng(1)
    for n in (1, 7, 8, 9, 64, 1000):
        gone = np.flatnonzero(dice.random(n) < 0.3)
        if len(gone):
            stays = ld.kept_lines(ld.keep_bitmap(gone), n)
            assert np.flatnonzero(~stays).tolist() == gone.tolist()
    assert ld.kept_lines(None, 3).all()
    assert len(ld.keep_bitmap(np.arange(100_000))) < 200
