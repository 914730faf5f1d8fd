from pyspark.sql import functions as F

from segspark.llm import mixing as X


def test_targets_fill_and_stop_at_the_cap(spark):
    docs = spark.createDataFrame([(i, "w " * 10, s) for i, s in enumerate("a" * 40 + "b" * 200 + "c" * 5)], "doc_id long, text string, source string")
    got = X.mix_sources(docs).groupBy("source").agg(F.first("source_size").alias("n"), F.first("target").alias("t"), F.sum("taken").alias("taken"), F.max("copies").alias("most")).orderBy("source").collect()
    # 3675 words to share by 3 : 1 : 2; c stops at 100, then a at 800, b gets the rest
    assert [(r["n"], r["t"]) for r in got] == [(400, 800.0), (2000, 2775.0), (50, 100.0)]
    assert [r["taken"] for r in got][::2] == [800, 100] and abs(got[1]["taken"] - 2775) < 300 and max(r["most"] for r in got) <= 2
    assert X.emit_copies(X.mix_sources(docs)).agg(F.sum("size")).first()[0] == sum(r["taken"] for r in got)


def test_reruns_agree_and_odd_documents(odd_docs, no_docs):
    a, b = (sorted(map(tuple, X.mix_sources(odd_docs.repartition(n)).drop("text").collect()), key=repr) for n in (1, 5))
    assert a == b and len(a) == odd_docs.count()
    rows = X.mix_sources(odd_docs).collect()
    assert all(r["taken"] <= 2 * r["size"] and r["source_size"] is not None for r in rows)
    assert X.mix_sources(no_docs).count() == 0 and X.emit_copies(X.mix_sources(no_docs)).count() == 0


def test_many_sources_rank_in_order(spark):
    names = [f"s{i:03d}" for i in range(300)] + [None, "é", "Z"]
    got = X.ranked(spark.createDataFrame([(n,) for n in names], "source string"), "source").collect()
    want = [*sorted((n for n in names if n is not None), key=lambda n: n.encode()), None]
    assert [r["source"] for r in sorted(got, key=lambda r: r["rank"])] == want and [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(303))


def filled(sizes, weights, budget, cap):
    """Targets by filling in rounds."""
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = budget * sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        level = (total - sum(cap * sizes[s] for s in full)) / sum(w[s] for s in rest) if rest else 0
        now = {s for s in rest if w[s] * level > cap * sizes[s]}
        if not now:
            return {s: cap * sizes[s] if s in full else w[s] * level for s in order}
        full |= now


def test_targets_against_filling_in_rounds(spark):
    import random

    r = random.Random(1)
    for weights, budget, cap in (((3, 1, 2), 1.5, 2), ((1, 9), 1.9, 2), ((1,), 2.5, 2), ((5, 1, 1, 1), 0.3, 1)):
        sizes = {**{f"s{i}": int(10 ** r.uniform(0, 6)) for i in range(60)}, None: 40, "zero": 0}
        sized = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {x["source"]: x["target"] for x in X.source_targets(sized, weights, budget, cap).collect()}
        want = filled(sizes, weights, budget, cap)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-9 * max(1, want[s]) for s in want)


def test_rows_without_an_id_draw_each_for_themselves(spark):
    docs = spark.createDataFrame([(None, f"w{i} " * 10, "a") for i in range(400)] + [(7, f"v{i} " * 10, "b") for i in range(400)] + [(i, "x " * 10, "c") for i in range(400)], "doc_id long, text string, source string")
    got = X.mix_sources(docs).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert len(got) == 3 and all(abs(r["taken"] - r["target"]) < 0.15 * r["target"] for r in got)
