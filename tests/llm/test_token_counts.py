import base64
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import segspark.llm.token_counts as token_counts_module
from segspark.llm.token_counts import TokenCounter, token_counts

tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
MODEL = tokenizers.path("piece_bpe_32k.model")


def texts():
    r = random.Random(8)
    letters = "abc etaoin  shrdlu.,\n\tÄéñ😀漢字▁ \u0000<s></s>"
    return ["", " ", "  two  ", "<s> <unk> </s> <0x0A>", "aaaaaaaaaaaaaaaaaaaaaaaa", "▁▁▁", "é", *("".join(r.choice(letters) for _ in range(r.randrange(1, 400))) for _ in range(150))]


def test_same_counts_as_the_library(spark, odd_docs):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = odd_docs.select("doc_id", "text", "n_tokens").unionByName(spark.createDataFrame([(100 + i, t, 0) for i, t in enumerate(texts())], "doc_id long, text string, n_tokens int"))
    got = token_counts(docs.withColumn("body", F.col("text")), MODEL).collect()
    assert len(got) == docs.count()
    for r in got:
        body = r["body"] or ""
        n = len(model.encode(body))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(body.encode()), n > 4096)


def test_no_documents(no_docs):
    assert token_counts(no_docs, MODEL).count() == 0


def one(counter, text):
    data = np.frombuffer(text.encode(), np.uint8)
    return int(counter.count(data, np.array([0, len(data)]))[0])


def test_long_sequences_count_like_the_library():
    r = random.Random(3)
    model, counter = sentencepiece.SentencePieceProcessor(model_file=MODEL), TokenCounter(MODEL)
    kinds = ["ab", "aeinrst", "=-", "etaoinshrdlucmfwyp", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "äöüéñ漢字a"]
    for i in range(300):
        text = "".join(r.choice(kinds[i % len(kinds)]) for _ in range(r.randrange(1, 900)))
        assert one(counter, text) == len(model.encode(text)), text
    words = "".join(r.choice(["the", "tion", "ing", "station", "internationalization", "a", "x"]) for _ in range(4000))
    assert one(counter, words) == len(model.encode(words))


def padded_table():
    r = random.Random(5)
    return "\n".join(" ".join(str(r.randint(0, 10 ** r.randint(1, 8))).rjust(r.choice([12, 40, 90, 200])) for _ in range(6)) for _ in range(2000))


RUNS = {"blanks": " " * 1_000_000, "blanks after a word": "word" + " " * 300_001 + "end", "tabs": "\t" * 500_000, "runs": "  a" * 300_000, "table": padded_table()}


@pytest.mark.parametrize("name", RUNS)
def test_long_runs_of_blanks(name):
    model, counter = sentencepiece.SentencePieceProcessor(model_file=MODEL), TokenCounter(MODEL)
    began = time.perf_counter()
    got = one(counter, RUNS[name])
    assert time.perf_counter() - began < 5
    assert got == len(model.encode(RUNS[name]))


@pytest.mark.parametrize("tries", [0, 1, 8])
def test_places_in_turn_count_like_the_library(monkeypatch, tries):
    monkeypatch.setattr(token_counts_module, "TRIES", tries)
    r = random.Random(tries)
    model, counter = sentencepiece.SentencePieceProcessor(model_file=MODEL), TokenCounter(MODEL)
    kinds = [" ", "=", "-", "ab", "aeinrst", " a", "\t", "etaoinshrdlu", "äöüéñ漢字a"]
    for i in range(400):
        kind = kinds[i % len(kinds)]
        text = "".join(r.choice(kind) for _ in range(r.randrange(1, 700))) if i % 2 else "".join(r.choice(kinds)[0] * r.randrange(1, 60) for _ in range(25))
        assert one(counter, text) == len(model.encode(text)), repr(text)


@pytest.mark.parametrize("text", ["a" * 1_000_000, "ab" * 500_000, "=" * 1_000_000, base64.b64encode(random.Random(1).randbytes(750_000)).decode()], ids=["a", "ab", "rule", "base64"])
def test_a_million_characters_without_a_blank(text):
    model, counter = sentencepiece.SentencePieceProcessor(model_file=MODEL), TokenCounter(MODEL)
    began = time.perf_counter()
    got = one(counter, text)
    assert time.perf_counter() - began < 5
    assert got == len(model.encode(text))
