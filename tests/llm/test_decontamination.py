import random
import re

import pyarrow as pa

from segspark.llm import decontamination as D

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())


def distance(pattern, text):
    """Smallest edit distance of the pattern to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        now = [i]
        for j, w in enumerate(text, 1):
            now.append(min(row[j - 1] + (p != w), row[j] + 1, now[j - 1] + 1))
        row = now
    return min(row)


def cases(seed=2):
    r = random.Random(seed)
    text = lambda n: [f"vñ{r.randrange(400)}" for _ in range(n)]
    items = [text(n) for n in (4, 5, 12, 15, 20, 33, 70, 15)]
    docs = [text(80) for _ in range(20)]
    for item in items:
        for edits in (0, 1, 2, len(item) // 5, len(item) // 5 + 1, len(item) // 3 + 1):
            x = list(item)
            for _ in range(edits):
                at = r.randrange(len(x) + 1)
                kind = r.randrange(3)
                x[at : at + (kind > 0)] = [] if kind == 1 else [f"n{r.randrange(99)}"]
            docs.append(text(r.randrange(30)) + x + text(r.randrange(30)))
    return [(i, " ".join(x).upper() + ".") for i, x in enumerate(docs)], [(i, ", ".join(x)) for i, x in enumerate(items)]


def test_against_brute_force(spark):
    docs, items = cases()
    want = {(d, i, k) for d, t in docs for i, p in items if (k := distance(words(p), words(t))) <= D.edit_budget(len(words(p)))}
    for block in (4 << 20, 200):
        got = D.decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), block_bytes=block).collect()
        assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got} == want and len(got) == len(want)
        for r in got:
            stretch = words(docs[r["doc_id"]][1])[r["first_word"] : r["end_word"]]
            assert distance(words(items[r["item_id"]][1]), stretch) == r["distance"]


def test_dropping_keeps_clean_documents_whole(spark, odd_docs, no_docs):
    docs, items = cases()
    frame, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    hit = {r["doc_id"] for r in D.decontaminate(frame, bench).collect()}
    for block in (4 << 20, 200):
        assert sorted(map(tuple, D.drop_contaminated(frame, bench, block_bytes=block).collect())) == [d for d in docs if d[0] not in hit]
    kept = D.drop_contaminated(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert D.drop_contaminated(no_docs, bench).count() == 0


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (None, "one"), (4, "zwölf BOXKÄMPFER"), (5, "one"), (5, "one")], ITEMS)
    got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in D.decontaminate(odd_docs, items).collect() if r["doc_id"] is not None and r["item_id"] is not None)
    assert got == [(3, 5, 0)] * 4 + [(4, 4, 0)]  # a repeated row finds a repeated item twice
    assert D.decontaminate(no_docs, items).count() == 0
    assert D.decontaminate(odd_docs, spark.createDataFrame([], ITEMS)).count() == 0


def test_any_number_of_blocks_is_one_scan(spark, tmp_path):
    docs, items = cases()
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "docs"))
    bench = spark.createDataFrame(items, ITEMS)
    path, blocks = D.item_blocks(bench, 200)
    assert blocks >= 3 and path
    frame = spark.read.parquet(str(tmp_path / "docs"))
    for found in (D.decontaminate(frame, bench, block_bytes=200), D.drop_contaminated(frame, bench, block_bytes=200)):
        assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_a_long_text_and_chunks_smaller_than_a_batch(spark, monkeypatch):
    docs, items = cases()
    monkeypatch.setattr(D, "CHUNK_BYTES", 300)
    filler = " ".join(f"f{i}" for i in range(100_000))
    some = [*docs, (1000, filler + " " + items[3][1] + " " + filler)]
    texts = pa.array([t for _, t in some])
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in some]), texts], names=["doc_id", "text"])
    chunks = list(D._chunks(iter([batch.slice(0, 50), batch.slice(50)]), 1))
    assert sum(len(w.counts) for c in chunks for *_, w in c) == len(some) and len(chunks) > 1
    got = D.decontaminate(spark.createDataFrame(some, DOCS), spark.createDataFrame(items, ITEMS)).filter("doc_id = 1000").collect()
    assert [(r["item_id"], r["distance"], r["first_word"]) for r in got] == [(3, 0, 100_000)]
