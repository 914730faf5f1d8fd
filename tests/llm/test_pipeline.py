import hashlib
import math
import os
import re

import numpy as np
import pytest
import test_decontamination
import test_ngram_join
import test_scans
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline as P
from segspark.llm._scratch import materialize, shared_dir
from segspark.llm.decontamination import decontaminate
from segspark.llm.ngram_join import components
from segspark.llm.secret_scan import secret_scan

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_operator_is_registered():
    names = E.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and len(P.STAGES) == 5


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = [docs]
    for name, stage in P.STAGES:
        kept.append(materialize(stage(spark, kept[-1], SF), "stage"))
    for before, after in zip(kept, kept[1:-1]):
        assert after.columns == docs.columns and 0 < after.count() <= before.count()
    good = docs.join(labels.filter("quality = 1"), "doc_id").count()
    assert kept[1].join(labels.filter("quality = 1"), "doc_id").count() > 0.95 * good
    # no near duplicates are left, and every group that was there has one document
    groups = materialize(components(kept[1], size=P.SHINGLE, percent=P.SIMILAR), "groups")
    assert kept[2].count() == groups.select("component_id").distinct().count()
    assert components(kept[2], size=P.SHINGLE, percent=P.SIMILAR).filter("component_id <> doc_id").count() == 0
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate(kept[3], items).count() == 0
    dirty = decontaminate(kept[2], items).select("doc_id").distinct().count()
    assert kept[3].count() == kept[2].count() - dirty
    assert secret_scan(kept[4]).filter("base_spans <> ''").count() == 0
    assert kept[4].count() == kept[3].count() and kept[4].filter(F.length("text") != F.col("n_chars")).count() == 0
    mix = kept[5]
    assert mix.select("doc_id").distinct().join(kept[4], "doc_id", "left_anti").count() == 0
    assert abs(mix.agg(F.sum("size")).first()[0] / (1.5 * mix.select("source", "source_size").distinct().agg(F.sum("source_size")).first()[0]) - 1) < 0.15


def nearest(pattern, text):
    """Smallest edit distance of the pattern to any stretch of the text, a row of the table at a time."""
    number = {}
    p, t = (np.array([number.setdefault(w, len(number)) for w in x]) for x in (pattern, text))
    row, steps = np.zeros(len(t) + 1, np.int64), np.arange(len(t) + 1)
    for i, x in enumerate(p, 1):
        now = np.concatenate(([i], np.minimum(row[:-1] + (t != x), row[1:] + 1)))
        row = np.minimum.accumulate(now - steps) + steps
    return row.min()


def brute_pipeline(docs, good, items):
    """The mix by plain loops, from the documents that the classifier keeps."""
    kept = [d for d in docs if d["doc_id"] in good]
    groups = {d: c for d, _, c in test_ngram_join.brute([(d["doc_id"], d["text"]) for d in kept], P.SHINGLE, P.SIMILAR)}
    kept = [d for d in kept if groups[d["doc_id"]] in (d["doc_id"], None)]
    items = [test_decontamination.words(t) for t in items]
    bodies = [test_decontamination.words(d["text"]) for d in kept]
    kept = [d for d, body in zip(kept, bodies) if not any(p and nearest(p, body) <= len(p) // 5 for p in items)]
    out = []
    for d in kept:
        text = d["text"] or ""
        strong = [(int(a), int(b)) for _, a, b in (x.split(":") for x in test_scans.brute_secrets(text).split(",") if x)]
        hidden = np.zeros(len(text) + 1, bool)
        begins = set()
        for a, b in sorted(strong + [(a, b) for _, a, b in test_scans.brute_linked(text, 300)]):
            if not hidden[a]:
                begins.add(a)
            hidden[a:b] = True
        new = "".join(("[SECRET]" if i in begins else "") + ("" if hidden[i] else c) for i, c in enumerate(text))
        out.append((d["doc_id"], new if d["text"] is not None else None, d["source"]))
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in out}
    sources = {}
    for i, _, s in out:
        sources[s] = sources.get(s, 0) + size[i]
    order = sorted(sources, key=lambda s: (s is None, s))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full, level = set(), 0.0
    while True:
        rest = [s for s in order if s not in full]
        level = (1.5 * sum(sources.values()) - sum(2 * sources[s] for s in full)) / sum(w[s] for s in rest) if rest else 0.0
        now = {s for s in rest if w[s] * level > 2 * sources[s]}
        if not now:
            break
        full |= now
    mix = []
    for i, t, s in out:
        rate = min(2.0 * sources[s], w[s] * level if s not in full else math.inf) / sources[s] if sources[s] else 0.0
        digest = hashlib.md5(f"{i}:{hashlib.md5((t or '').encode()).hexdigest()}:mix-0".encode()).hexdigest()
        copies = math.floor(rate) + (int(digest[:13], 16) / 2**52 < rate - math.floor(rate))
        mix += [(i, t, s, c) for c in range(1, copies + 1)]
    return mix


def test_run_against_brute_force(spark):
    small = "/root/testdata/sf0.001"
    docs = [r.asDict() for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    good = {r["doc_id"] for r in P.STAGES[0][1](spark, spark.read.parquet(f"{small}/documents.parquet"), small).select("doc_id").collect()}
    assert 0 < len(good) < len(docs) and len({d["doc_id"] for d in docs}) == len(docs)
    want = brute_pipeline(docs, good, [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()])
    got = P.run(spark, small).select("doc_id", "text", "source", "copy").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and len(want) > 50


def test_run_is_the_stages(spark):
    a, b = P.run(spark, SF), P.run(spark, SF)
    assert a.exceptAll(b).count() == 0 and a.count() == b.count() > 0


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_shared_folder_is_the_one_that_is_set(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
