import hashlib
import re
import re._constants as sre
import re._parser as sre_parser
import time

import pytest
from pyspark.sql import functions as F

from segspark.llm import license_scan as L
from segspark.llm import secret_scan as Z

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))


def base_places(t):
    w, out = words(t), []
    for phrase, label in L.BASE.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return out


LICENSED = ["Under the MIT License. UNDER THE MIT LICENSE!", "apache license, version 2.0", "CC-BY-NC 4.0 and cc by nc sa", "Licensed under the GPL v3 or later", "under the mitx license", "spdx-license-identifier: BSD-3-Clause"]


def test_base_places_against_brute_force(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(LICENSED)], "doc_id long, text string"))
    for r in L.license_scan(docs.withColumn("body", F.col("text"))).collect():
        want = base_places(r["body"])
        base = [(d["start"], d["label"]) for d in r["detections"] if d["rule"].startswith("base:")]
        assert sorted(base) == sorted(want) and r["n_words"] == len(words(r["body"]))
        assert {label for _, label in want} <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1


def test_suppression_by_containment_and_priority(spark):
    rules = [L.Rule("a", "long", "x", "x y z", 1, 0.9), L.Rule("b", "short", "x", "x y", 1, 0.5), L.Rule("c", "weak", "z", "z q", 2, 0.5), L.Rule("d", "inner", "y", "y", 5, 0.5), L.Rule("e", "other", "nokey", "y", 0, 0.5)]
    r = L.license_scan(spark.createDataFrame([(1, "x y z q")], "doc_id long, text string"), rules=rules).first()
    assert {d["rule"] for d in r["detections"]} == {"a", "b", "c", "d"} and {d["rule"] for d in r["kept"]} == {"a", "c"} and r["labels"] == "long,weak"


def test_hundreds_of_rules_whose_gates_are_in_them():
    rules = L.signature_rules()
    assert len(rules) > 200 and len({r.name for r in rules}) == len(rules)
    got = {t: [d["label"] for d in L.Scanner(rules).scan(t.encode())[1]] for t in LICENSED}
    assert "gpl-3" in got[LICENSED[3]] and "bsd-3" in got[LICENSED[5]] and not got[LICENSED[4]]


def forms(pattern):
    """Texts that match, at least one for each choice of alternatives and optional parts."""

    def walk(parts):
        out = [""]
        for op, x in parts:
            if op is sre.LITERAL:
                some = [chr(x)]
            elif op is sre.SUBPATTERN:
                some = walk(x[3])
            elif op is sre.BRANCH:
                some = [t for way in x[1] for t in walk(way)]
            elif op is sre.IN:
                some = [chr(v) if o is sre.LITERAL else chr(v[0]) if o is sre.RANGE else {sre.CATEGORY_DIGIT: "7", sre.CATEGORY_NOT_SPACE: "q"}[v] for o, v in x]
            else:
                assert op in (sre.MAX_REPEAT, sre.MIN_REPEAT)
                some = [t * n for n in {x[0], min(x[1], x[0] + 1)} for t in walk(x[2])]
            out = [a + b for a in out for b in dict.fromkeys(some)]
        return out

    found = walk(sre_parser.parse(pattern))
    assert all(re.fullmatch(pattern, t) for t in found)
    return found


def test_gates_are_in_all_that_names_and_signatures_match():
    rules = L.signature_rules()
    for keyword, pattern in [*L.LICENSES.values(), *((k, p) for _, k, p, _ in L.SIGNATURES), *((p, p) for p in L.BASE)]:
        for text in forms(pattern):
            assert any(k in text for k in keyword.split("|")), (keyword, text)
    for text, label in (("released under the expat license", "mit"), ("a proprietary license", "proprietary"), ("license expat", "mit")):
        alone = {r.name for r in rules if re.search(rf"(?<= )(?:{r.pattern})(?= )", f" {text} ")}
        got = L.Scanner(rules).scan(text.encode())[1]
        assert {d["rule"] for d in got} == alone and label in {d["label"] for d in got}


def test_suppression_against_its_definition():
    import random

    r = random.Random(7)
    for _ in range(300):
        found = []
        for _ in range(r.randrange(0, 30)):
            start = r.randrange(12)
            found.append({"start": start, "end": start + r.randrange(1, 8), "priority": r.randrange(4)})
        L.suppress(found)
        for x in found:
            covers = [y for y in found if y["start"] <= x["start"] and y["end"] >= x["end"]]
            assert x["kept"] == (not any(y["priority"] < x["priority"] or (y["priority"] == x["priority"] and y["end"] - y["start"] > x["end"] - x["start"]) for y in covers))


@pytest.mark.parametrize("piece", ["under the mit license ", "mit ", "permission is hereby granted ", "neither the name of a b c ", "gpl v2 or later license ", "creativecommons org licenses by 4 0 ", "licensed under the terms of the "])
def test_repeated_phrases_take_linear_time(piece):
    scanner = L.Scanner(L.signature_rules())
    scanner.scan(b"warm up")
    began = time.perf_counter()
    n, found = scanner.scan((piece * (1_000_000 // len(piece))).encode())
    assert n > 100_000 and time.perf_counter() - began < 12


def test_each_signature_is_its_own():
    assert len(L.SIGNATURES) >= 200 and len({p for _, _, p, _ in L.SIGNATURES}) == len(L.SIGNATURES)
    scanner = L.Scanner(L.signature_rules())
    for i, (label, _, pattern, _) in enumerate(L.SIGNATURES):
        for text in forms(pattern)[:4]:
            rules = {d["rule"] for d in scanner.scan(f"some {text} words".encode())[1]}
            assert f"text:{i}:{label}" in rules, (label, text)


def test_words_with_odd_blanks_do_not_break_a_match():
    got = L.Scanner(L.signature_rules()).scan("neither the name of A\u00a0B\u2003C nor the names of its contributors".encode())[1]
    assert "bsd-3" in {d["label"] for d in got}


def brute_secrets(t):
    t, out = t or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        out += [(m.start(), 0, "assign", m.end())] if len(m[2]) >= 6 else []
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


SECRETS = ['😀 token = "abcdef123"', "API_KEY: short", "ApiKey=" + "ab" * 20, "AKIA" + "A1" * 10 + " AKIA" + "B" * 10, "deadbeef" * 4 + "x" + "0" * 24, "passwd:secret=token:abcdefgh", "ſecret=abcdefg toKen=abcdefg"]


def test_base_spans_against_brute_force(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "_row", "strong").unionByName(spark.createDataFrame([(100 + i, t, 1, 2) for i, t in enumerate(SECRETS)], "doc_id long, text string, _row int, strong int"))
    got = Z.secret_scan(docs.withColumn("body", F.col("text"))).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["base_spans"] == brute_secrets(r["body"])
        assert set(filter(None, r["base_spans"].split(","))) <= set(r["spans"].split(","))


CASES = {
    "user = bob.smith and https://api.example.com/v1 token = abcdefgh1": {"account", "endpoint"},
    "user = bob.smith with nothing else": set(),
    "https://api.example.com/v1 token = abcdefgh1": set(),
    "user = bob.smith\n\ntoken = abcdefgh1": set(),
    "user = bob.smith " + "x " * 400 + "token = abcdefgh1": set(),
    "AKIA" + "A1" * 8 + " aB3" + "xY7z" * 5: {"opaque"},
}


def brute_weak(t, strong):
    """Weak parts by plain loops: earlier kinds first, no overlap with what is there."""
    kinds = {"account": Z.ACCOUNT, "opaque": Z.OPAQUE, "endpoint": Z.ENDPOINT}
    found = {k: [m.span() for m in p.finditer(t)] for k, p in kinds.items()}
    if not found["account"] and not any(k == "access" for k, _, _ in strong):
        return []
    out = []
    for k, spans in found.items():
        for s, e in spans:
            if all(e <= a or b <= s for _, a, b in [*strong, *out]):
                out.append((k, s, e))
    return out


def brute_linked(t, reach):
    strong = Z.strong_parts(t)
    weak = brute_weak(t, strong)
    scope = lambda s: sum(m.start() <= s for m in Z.BLANK.finditer(t))

    def meets(x, role):
        return Z.ROLES[x[0]] == role or any(Z.ROLES[y[0]] == role and scope(y[1]) == scope(x[1]) and y[1] <= x[2] + reach and y[2] >= x[1] - reach for y in strong + weak)

    return sorted(x for x in weak if meets(x, "identifier") and meets(x, "secret"))


def secret_texts(seed=9):
    import random

    r = random.Random(seed)
    bits = ["user = bob.smith", "client_id: x_12345", "login=ann@x.y", "token = abcdefgh1", "secret:s3cr3t/val", "AKIA" + "A1" * 8, "aB3xY7zQ9kLm2NpR4sTu", "0123456789abcdef01", "ab" * 14, "https://api.example.com/v1?token=abcdef99", "10.0.0.1:8080", "db-1.example.com:5432", "a-b.c", "user", "\n\n", "\n", "\n \t\n", "word " * 9, "x" * 40 + " ", "y " * 60, "é😀"]
    return ["".join(r.choice(bits) + r.choice([" ", " ", "\n", ", ", ""]) for _ in range(r.randrange(1, 25))) for _ in range(400)]


@pytest.mark.parametrize("reach", [300, 40])
def test_links_against_brute_force(spark, reach):
    texts = secret_texts()
    got = Z.secret_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), reach=reach).collect()
    n = 0
    for r in got:
        want = brute_linked(texts[r["doc_id"]], reach)
        assert sorted((x["kind"], x["start"], x["end"]) for x in r["linked"]) == want
        n += len(want)
    assert n > 300 and len(got) == len(texts)


@pytest.mark.parametrize("piece", ["a-", "a.", "a", "user=abc ", "token=abcdef ", "user=abc aB3xY7zQ9kLm2NpR4sTu http://x.y/z ", "user ", "AKIA", "0f", "\n ", "http://", "1.1.1.", "aA1+"])
def test_a_million_characters_take_no_time(piece):
    text = "user=bob1 " + piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    strong = Z.strong_parts(text)
    weak = Z.weak_parts(text, strong)
    Z.redact(text, [(s, e) for _, s, e in strong + weak])
    assert time.perf_counter() - began < 2


@pytest.mark.parametrize("reach", [300])
def test_weak_parts_need_complements(spark, reach):
    docs = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    for r in Z.secret_scan(docs, reach=reach).collect():
        assert {s["kind"] for s in r["linked"]} == list(CASES.values())[r["doc_id"]]


def test_hash_of_spans(spark, tmp_path):
    spark.createDataFrame([(1, SECRETS[0], "x"), (2, None, "x")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in Z.op7_secret_scan(spark, str(tmp_path)).collect()}
    assert rows[1]["base_sha256"] == hashlib.sha256(brute_secrets(SECRETS[0]).encode()).hexdigest() and rows[1]["n_assign"] == 1
    assert rows[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and rows[2]["spans"] == ""


def test_redaction(spark, odd_docs):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*SECRETS, *CASES])], "doc_id long, text string")
    for r in Z.redact_documents(docs).collect():
        assert not brute_secrets(r["text"])
    same = Z.redact_documents(odd_docs).select("doc_id", "text")
    assert sorted(map(tuple, same.collect()), key=repr) == sorted(map(tuple, odd_docs.select("doc_id", "text").collect()), key=repr)
    assert Z.redact_documents(odd_docs).columns == odd_docs.columns


def test_no_documents(no_docs):
    assert L.license_scan(no_docs).count() == 0 and Z.secret_scan(no_docs).count() == 0 and Z.redact_documents(no_docs).count() == 0
