"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Every passage of the whole text is
encoded to a vector of shape measures (which kinds of characters it has, how long and how
varied its words are, how much stands twice), computed with array operations over Arrow
batches.  A small network embeds the passages, gated attention weighs them,

    a_i = softmax_i( w . (tanh(V h_i) * sigmoid(U h_i)) ),   z = sum_i a_i h_i,

and a logistic unit scores z.  Attention and classifier are learned together from the
labels of documents alone.  Training uses all passages of at most ``sample_docs`` labelled
documents, those with the smallest hashes, that have ``sample_passages`` together; scoring
uses all passages of all documents.

Defined results: null and empty texts are one passage without words and get its score;
labelled rows with a null label are left out; a doc_id labelled more than once counts as
the mean of its labels; of documents that share a doc_id the one whose text has the
smallest hash stands for it in training; without any usable label every score is 0.5; repeated rows get
equal scores; an empty table gives an empty result; further columns pass through, the
columns that are added replace those of the same name.  Labels, lang, source and doc_id
never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from segspark.llm._scratch import discard, materialize, text_slices
from segspark.llm._words import Words

PASSAGE = 64
THRESHOLD = 0.3
#: Labelled documents that are learned from, and passages that they may have together.
SAMPLE_DOCS, SAMPLE_PASSAGES = 4000, 200_000
#: Embedding and attention widths, epochs, step and weight decay of the training.
HIDDEN, GATE, EPOCHS, STEP, DECAY = 16, 8, 150, 0.02, 1e-4

# Kinds of bytes: other, lower, upper, digit, blank, line end, sentence marks, pipes and
# bullets, symbols, quotes and brackets, ! and ?, first and later bytes of other characters.
_KIND = np.zeros(256, np.int64)
for _i, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\v\f", "\n", ".,;:", "|-", "#*$%&<>=+~^@_/\\", "\"'()[]{}`", "!?"), 1):
    _KIND[[ord(_c) for _c in _chars]] = _i
_KIND[0xC0:] = 11
_KIND[0x80:0xC0] = 12
_KINDS = 13
FEATURES = _KINDS + 7


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passage vectors of a slice of texts, and the number of passages of each text."""
    texts = len(offsets) - 1
    words = Words(data, offsets)
    count = np.maximum(1, -(-words.counts // PASSAGE))
    base = np.concatenate(([0], np.cumsum(count)))
    total = int(base[-1])
    inner = np.arange(len(words.starts)) - words.first[words.text]
    passage = base[words.text] + inner // PASSAGE
    n = np.bincount(passage, minlength=total).astype(np.float64)
    # A passage begins with its first word; what precedes a text's first word is its too.
    first = np.flatnonzero(inner % PASSAGE == 0)
    begin = np.zeros(total, np.int64)
    begin[passage[first]] = words.starts[first]
    begin[base[:-1]] = offsets[:-1]
    size = np.diff(np.append(begin, len(data)))
    kinds = np.bincount(np.repeat(np.arange(total), size) * _KINDS + _KIND[data], minlength=total * _KINDS).reshape(total, _KINDS).astype(np.float64)
    some, chars = np.maximum(n, 1), np.maximum(size, 1).astype(np.float64)

    def share(same: np.ndarray, lag: int) -> np.ndarray:
        here = passage[lag:][same & (passage[lag:] == passage[:-lag])]
        return np.bincount(here, minlength=total) / some

    h = words.hashes
    varied = (np.bincount(passage * 64 + (h & np.uint64(63)).astype(np.int64), minlength=total * 64).reshape(total, 64) > 0).sum(1)
    x = np.empty((total, FEATURES), np.float32)
    x[:, :_KINDS] = np.sqrt(kinds / chars[:, None])
    x[:, _KINDS] = np.log1p(n)
    x[:, _KINDS + 1] = np.log1p(chars / some)
    x[:, _KINDS + 2] = varied / (64 * (1 - np.exp(-some / 64)))
    for i, lag in enumerate((1, 2)):
        x[:, _KINDS + 3 + i] = share(h[lag:] == h[:-lag], lag) if len(h) > lag else 0
    x[:, _KINDS + 5] = np.sqrt(kinds[:, 2] / np.maximum(kinds[:, 1] + kinds[:, 2], 1))
    x[:, _KINDS + 6] = np.log1p(np.repeat(words.counts, count) / PASSAGE)
    assert len(count) == texts
    return x, count


class GatedAttention:
    """The network over standardised passage vectors; arrays only, so it travels to tasks."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        n = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"W": n(FEATURES, HIDDEN), "c": np.zeros(HIDDEN, np.float32), "V": n(HIDDEN, GATE), "U": n(HIDDEN, GATE), "w": n(GATE), "o": n(HIDDEN), "b": np.zeros(1, np.float32)}
        self.mean, self.scale, self.trained = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32), False
        self.taken: list = []  # ids of the documents it was trained on

    def _forward(self, x: np.ndarray, count: np.ndarray) -> dict:
        p, starts = self.p, np.cumsum(count) - count
        h = np.tanh(x @ p["W"] + p["c"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), count))
        a = e / np.repeat(np.add.reduceat(e, starts), count)
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "y": 1 / (1 + np.exp(-(z @ p["o"] + p["b"])))}

    def score(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(count), 0.5)
        return self._forward((x - self.mean) / self.scale, count)["y"]

    def gradient(self, x: np.ndarray, count: np.ndarray, label: np.ndarray) -> dict:
        """Of the mean logistic loss of the documents, by parameter."""
        p, f, starts = self.p, self._forward(x, count), np.cumsum(count) - count
        dy = (f["y"] - label) / x.dtype.type(len(label))
        dz = np.repeat(dy[:, None] * p["o"], count, axis=0)
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), count))
        g = de[:, None] * p["w"]
        dt, ds = g * f["s"] * (1 - f["t"] ** 2), g * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": x.T @ dh, "c": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ de, "o": f["z"].T @ dy, "b": np.array([dy.sum()])}

    def fit(self, x: np.ndarray, count: np.ndarray, label: np.ndarray, epochs: int = EPOCHS) -> GatedAttention:
        """Full-batch Adam on the logistic loss of the documents."""
        self.mean, self.scale = x.mean(0, dtype=np.float64).astype(np.float32), (x.std(0, dtype=np.float64) + 1e-3).astype(np.float32)
        label = label.astype(np.float32)
        x, p = (x - self.mean) / self.scale, self.p
        m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        for i in range(1, epochs + 1):
            grad = self.gradient(x, count, label)
            rate = STEP * min(1, 2 * (1 - i / (epochs + 1)))
            for k in p:
                d = grad[k] + DECAY * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.999 * m2[k] + 0.001 * d * d
                p[k] = p[k] - rate * (m1[k] / (1 - 0.9**i)) / (np.sqrt(m2[k] / (1 - 0.999**i)) + 1e-8)
        self.trained = True
        return self


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_passages: int = SAMPLE_PASSAGES) -> GatedAttention:
    """A model learned from labelled rows outside the held-out fold.

    What reaches the driver is ``sample_passages`` vectors at most: documents are taken in
    the order of their hashes, all their passages or, where these don't fit any more, none; the
    next ones then fill what is left."""
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    known = usable.groupBy("doc_id").agg(F.avg("quality").cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label")
    bags = texts.agg(F.min_by(F.struct("text"), F.struct(F.xxhash64("text"), F.length("text"))).alias("of")).select("doc_id", "label", "of.text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(2)):
                x, count = encode(data, offsets)
                ends = np.cumsum(count)
                own = [x[e - n : e].astype("<f4").tobytes() for e, n in zip(ends, count)]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:2]), pa.array(count), pa.array(own, pa.binary())], names=["doc_id", "label", "n", "x"])

    rows = materialize(bags.mapInArrow(vectors, StructType([docs.schema["doc_id"], *StructType.fromDDL("label double, n long, x binary")])), "bags")
    sizes = rows.select("doc_id", "n").orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # sample_docs at most
    taken, room = [], sample_passages
    for r in sizes:
        if r["n"] <= room:
            taken.append(r["doc_id"])
            room -= r["n"]
    kept = rows if len(taken) == len(sizes) else rows.filter(F.col("doc_id").isin(taken))
    found = {r["doc_id"]: r for r in kept.collect()}
    discard(rows)
    model = GatedAttention()
    model.taken = taken
    if not taken:
        return model
    bag = [np.frombuffer(found[i]["x"], "<f4").reshape(-1, FEATURES) for i in taken]
    return model.fit(np.concatenate(bag), np.array([len(x) for x in bag]), np.array([found[i]["label"] for i in taken]))


def classify(docs: DataFrame, model: GatedAttention, text: str = "text", keep_text: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``, with or without the text itself."""
    own = [f for f in docs.schema.fields if f.name not in ("score", "predicted") and (keep_text or f.name != text)]
    schema = StructType([*own, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch.column(len(own))
            score = np.empty(len(body))
            for lo, hi, data, offsets in text_slices(body):
                score[lo:hi] = shared.value.score(*encode(data, offsets))
            columns = [*batch.columns[: len(own)], pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    columns = [F.col(f"`{f.name}`") for f in own]
    return docs.select(*columns, F.col(f"`{text}`").alias("_body")).mapInArrow(run, schema)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
